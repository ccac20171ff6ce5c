"""The columns and the natural key of every table.

Fact tables also carry a ``month`` partition column on disk.  All timestamps are UTC.
"""

from __future__ import annotations

from pyspark.sql.types import StructType

_FACTS = """
matches | match_id | match_id long, start_time timestamp, duration_s long, winning_team long, match_mode long, game_mode long, ranked_type long, rank_interval long, average_badge_team0 long, average_badge_team1 long, not_scored boolean
players | match_id, account_id | match_id long, start_time timestamp, account_id long, hero_id long, team long, player_slot long, assigned_lane long, won boolean, player_match_outcome long, player_rank_initial_display_rank long, player_rank_initial_flat_progress long, player_rank_final_flat_progress long, player_rank_desired_progress_change long, player_rank_initial_calibration_games long, player_rank_initial_demotion_protection_games long, player_rank_consumed_demotion_protection boolean, player_rank_initial_win_streak long, kills long, deaths long, assists long, net_worth long, last_hits long, denies long, mvp_rank long, party long, abandon_time_s long
hero_xp_rewards | match_id, account_id, hero_id, reason | match_id long, start_time timestamp, account_id long, hero_id long, xp_grant long, reason long
stats | match_id, account_id, time_stamp_s | match_id long, start_time timestamp, account_id long, hero_id long, time_stamp_s long, net_worth long, souls_player long, souls_player_orbs long, souls_lane_creep_orbs long, souls_neutral_creep_orbs long, souls_boss long, souls_boss_orb long, souls_treasure long, souls_denied long, souls_death_loss long, souls_lane_creep long, souls_neutral_creep long, kills long, deaths long, assists long, creep_kills long, neutral_kills long, possible_creeps long, creep_damage long, player_damage long, neutral_damage long, boss_damage long, denies long, player_healing long, ability_points long, self_healing long, player_damage_taken long, max_health long, weapon_power long, tech_power long, shots_hit long, shots_missed long, damage_absorbed long, absorption_provided long, hero_bullets_hit long, hero_bullets_hit_crit long, heal_prevented long, heal_lost long, damage_mitigated long, level long, player_barriering long, teammate_healing long, teammate_barriering long, self_damage long, bullet_kills long, melee_kills long, ability_kills long, headshot_kills long
soul_sources | match_id, account_id, time_stamp_s, source | match_id long, start_time timestamp, account_id long, hero_id long, time_stamp_s long, source long, souls long, souls_orbs long
item_events | match_id, account_id, game_time_s, item_id | match_id long, start_time timestamp, account_id long, hero_id long, game_time_s long, item_id long, item string, cost long, slot string, tier long, sold_time_s long, flags long, imbued_ability_id long
accolades | match_id, account_id, accolade_id | match_id long, start_time timestamp, account_id long, hero_id long, accolade_id long, value long, threshold long
buffs | match_id, account_id, type | match_id long, start_time timestamp, account_id long, hero_id long, type string, count long, permanent boolean
stacks | match_id, account_id, ability_id | match_id long, start_time timestamp, account_id long, hero_id long, ability_id long, value long
custom_stats | match_id, account_id, time_stamp_s, group, stat | match_id long, start_time timestamp, account_id long, hero_id long, time_stamp_s long, group string, stat string, value long
damage | match_id, account_id, target_player_slot, source_class, stat | match_id long, start_time timestamp, account_id long, hero_id long, target_account_id long, target_player_slot long, source_class string, stat string, damage long
damage_sources | match_id, account_id, source_class, stat, vs_heroes, time_stamp_s | match_id long, start_time timestamp, account_id long, hero_id long, source_class string, stat string, vs_heroes boolean, time_stamp_s long, damage long
damage_targets | match_id, account_id, target_account_id, source_class, stat, time_stamp_s | match_id long, start_time timestamp, account_id long, hero_id long, target_account_id long, source_class string, stat string, time_stamp_s long, damage long
mid_boss | match_id, destroyed_time_s | match_id long, start_time timestamp, destroyed_time_s long, team_killed long, team_claimed long
objectives | match_id, team, objective_id | match_id long, start_time timestamp, team long, objective_id long, destroyed_time_s long, first_damage_time_s long, player_damage long, player_spirit_damage long, creep_damage long
movement | match_id, account_id, game_time_s | match_id long, start_time timestamp, account_id long, hero_id long, game_time_s long, x double, y double, health_percent long, combat_type string, move_type string
movement_intervals | match_id, account_id, start_s | match_id long, start_time timestamp, account_id long, hero_id long, start_s long, alive_s long, moving_s long, stationary_s long, slide_s long, in_air_s long, zipline_s long, combat_s long, dashes long, air_dashes long, distance double
deaths | match_id, account_id, game_time_s | match_id long, start_time timestamp, account_id long, hero_id long, game_time_s long, time_to_kill_s double, death_duration_s long, killer_account_id long, x double, y double, z double, killer_x double, killer_y double, killer_z double
downloads | match_id, account_id, hero_id | match_id long, account_id long, player string, hero_id long, rank long, region string, downloaded_at timestamp
"""
_DIMENSIONS = """
item_history |  | item_id long, name string, class_name string, cost long, slot string, tier long, is_active boolean, description string, era_from timestamp, client_version long
item_component_history |  | item_id long, position long, component_class_name string, era_from timestamp, client_version long
hero_history |  | hero_id long, name string, class_name string, hero_type string, gun_tag string, complexity long, player_selectable boolean, disabled boolean, era_from timestamp, client_version long
hero_level_history |  | hero_id long, level long, required_souls long, standard_upgrade boolean, era_from timestamp, client_version long
hero_level_currency_history |  | hero_id long, level long, currency string, amount long, era_from timestamp, client_version long
hero_cost_bonus_history |  | hero_id long, slot string, position long, souls long, bonus double, era_from timestamp, client_version long
hero_stat_history |  | hero_id long, stat string, value double, era_from timestamp, client_version long
hero_level_up_history |  | hero_id long, stat string, per_level_value double, era_from timestamp, client_version long
ability_history |  | ability_class string, id long, name string, hero long, kind string, description string, era_from timestamp, client_version long
ability_property_history |  | ability_class string, property string, value double, scale_stat string, scale double, era_from timestamp, client_version long
ability_upgrade_history |  | ability_class string, tier long, property string, bonus double, type string, stat string, era_from timestamp, client_version long
ability_weapon_history |  | ability_class string, bullet_damage double, bullets double, clip_size double, cycle_time double, reload_duration double, bullets_per_second double, damage_per_second double, bullet_speed double, crit_bonus_start double, crit_bonus_end double, crit_bonus_start_range double, crit_bonus_end_range double, damage_falloff_start_range double, damage_falloff_end_range double, damage_falloff_end_scale double, range double, era_from timestamp, client_version long
rank_history |  | tier long, name string, era_from timestamp, client_version long
statue_history |  | class_name string, buff string, level long, stat string, value double, era_from timestamp, client_version long
"""


def _parse(text: str) -> dict[str, tuple[list[str], StructType]]:
    found = {}
    for line in text.strip().splitlines():
        name, key, columns = (part.strip() for part in line.split("|"))
        schema = StructType()
        for column in columns.split(", "):
            column_name, kind = column.split(" ")
            schema.add(column_name, kind)
        found[name] = ([k.strip() for k in key.split(",") if k.strip()], schema)
    return found


#: What columns hold, by name, wherever the name alone doesn't say it.
_DESCRIPTIONS = """
match_id: number of the match
start_time: start of the match, UTC
duration_s: length of the match in seconds
winning_team: side that won, 0 or 1
match_mode: number of the matchmaking mode
game_mode: number of the rules that were played
ranked_type: null or above 0 in ranked matches
average_badge_team0: mean badge of side 0; null or 0 where unknown
average_badge_team1: mean badge of side 1; null or 0 where unknown
not_scored: whether the result counts for no rating
account_id: account of the player
hero_id: number of the hero played
team: side of the player or building, 0 or 1
player_slot: place of the player in the match
assigned_lane: lane at the start
won: whether the player's side won
player_match_outcome: how the match ended for this player; 5 is no score
player_rank_initial_display_rank: badge before the match
player_rank_initial_flat_progress: rating points before the match
player_rank_final_flat_progress: rating points after the match
player_rank_desired_progress_change: points assigned, before floors are applied
player_rank_initial_calibration_games: placing games left before the match
net_worth: souls held and spent so far
last_hits: creeps finished
denies: orbs denied
party: number of the party, null without one
abandon_time_s: second at which the player left, null if they stayed
time_stamp_s: second of the sample; figures are totals so far
souls: souls from the source so far
souls_orbs: part of the souls that came as orbs
source: number of the income source
game_time_s: second of the match
item_id: number of the item or upgrade
item: name of the item as of the match
cost: price of the item as of the match
slot: category of the item
tier: tier of the item, ability or rank
sold_time_s: second of the sale, 0 if kept
imbued_ability_id: ability that the item was bound to, null without one
accolade_id: number of the award
threshold: step of the award that was reached
count: how often the buff was taken
permanent: whether the buff lasts for the whole match
ability_id: ability or item that the counter belongs to
group: text before the separator in the counter's name, null without one
stat: name of the figure
target_account_id: account of the target, null for what is no player
target_player_slot: place of the target in the match
source_class: class name of what dealt the damage
damage: amount so far, of the kind that stat names
vs_heroes: whether the targets are players
destroyed_time_s: second at which it fell, null if it stands
team_killed: side that killed the boss
team_claimed: side that took its reward
objective_id: number of the building
first_damage_time_s: second of the first damage to it, null without any
health_percent: share of health left
combat_type: what the player fought in this second
move_type: how the player moved in this second
start_s: first second of the interval
alive_s: seconds alive
moving_s: seconds with a known step
stationary_s: seconds with a step below the limit of standing
distance: length of the way, without jumps
time_to_kill_s: seconds from the first damage to the death
death_duration_s: seconds until the return
killer_account_id: account of the killer, null for what is no player
rank: place on the ladder at the download
downloaded_at: when the match was fetched
era_from: first moment at which the row holds
client_version: version of the game that brought the row
position: place in the order, from 0
component_class_name: class name of an item that is built into this one
required_souls: souls at which the level is reached
standard_upgrade: whether the level raises the hero's figures
per_level_value: what each such level adds
amount: what the level gives of the currency
bonus: what is added at this step
scale_stat: figure that the property grows with
scale: how much it grows by that figure
"""
DESCRIPTIONS = dict(line.split(": ", 1) for line in _DESCRIPTIONS.strip().splitlines())


def described(column: str) -> str:
    """What a column holds; a name without an entry is read as words."""
    return DESCRIPTIONS.get(column) or column.removesuffix("_s").replace("_", " ") + (" in seconds" if column.endswith("_s") else "")


FACTS = _parse(_FACTS)
DIMENSIONS = _parse(_DIMENSIONS)
TABLES = {name: schema for name, (_, schema) in (FACTS | DIMENSIONS).items()}
#: Natural keys; a dimension's rows are told apart by all that comes before its values and by ``era_from``.
KEYS = {name: key for name, (key, _) in FACTS.items()} | {
    "item_history": ["item_id", "era_from"],
    "item_component_history": ["item_id", "position", "era_from"],
    "hero_history": ["hero_id", "era_from"],
    "hero_level_history": ["hero_id", "level", "era_from"],
    "hero_level_currency_history": ["hero_id", "level", "currency", "era_from"],
    "hero_cost_bonus_history": ["hero_id", "slot", "position", "era_from"],
    "hero_stat_history": ["hero_id", "stat", "era_from"],
    "hero_level_up_history": ["hero_id", "stat", "era_from"],
    "ability_history": ["ability_class", "era_from"],
    "ability_property_history": ["ability_class", "property", "era_from"],
    "ability_upgrade_history": ["ability_class", "tier", "property", "era_from"],
    "ability_weapon_history": ["ability_class", "era_from"],
    "rank_history": ["tier", "era_from"],
    "statue_history": ["class_name", "era_from"],
}
