"""Parameters of the engine. The numbers are fixed values of the domain's semantics."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EloConfig:
    default_rating: float = 1500.0
    k_factor: float = 32.0
    regression: float = 0.005
    floor: float = 1000.0
    ceiling: float = 2500.0
    base: float = 400.0
    mode: str = "current"  # or "legacy": how non-finishers score


@dataclass(frozen=True)
class HistoryConfig:
    horse: int = 30
    jockey: int = 100
    trainer: int = 150
    deadline_minutes: int | None = 5  # None: the older generation, which sees all earlier races
    chunk_rows: int = 50_000  # rows of one entity that share a window partition
    older_features: bool = False  # the older generation's definitions of consistency (5 races), class movement (3, all known) and a last win (position 1)


#: The older generation's histories: shorter, without a deadline.
OLDER_HISTORY = HistoryConfig(20, 50, 100, deadline_minutes=None, older_features=True)


@dataclass(frozen=True)
class FeatureConfig:
    default_position: float = 10.0
    default_days_between: float = 21.0
    similar_distance_m: float = 200.0


@dataclass(frozen=True)
class SelectionConfig:
    variance_threshold: float = 1e-6
    strict_variance: bool = False  # whether a variance equal to the threshold stays
    correlation_threshold: float = 0.98
    any_partner: bool = False  # whether every column with an earlier partner goes, whatever the variances
    use_model: bool = True
    cumulative_importance: float = 0.995
    trees: int = 100
    patience: int | None = 20  # trees that may bring no better AUC on validation rows before training counts as over; the best one is the last that is kept. None: stop_below instead
    stop_below: float = 1e-4  # the share of the validation error that one more tree must win, else training stops
    importance: str = "splits"  # how many nodes split on a feature; or "gain"
    permutation: bool = True  # reported only
    permutation_repeats: int = 10
    permutation_rows: int | None = 100_000  # about so many validation rows are judged, chosen by hash; None: all
    test_size: float = 0.15
    val_size: float = 0.15
    seed: int = 42


#: The older generation's selector: rules alone, without a model.
OLDER_SELECTION = SelectionConfig(strict_variance=True, correlation_threshold=0.999, any_partner=True, use_model=False)


#: Scales of going: one for changes between races, one for the firmness index. Fixed values.
GOING_CHANGE = {
    "Firm": 5.0, "Good to Firm": 4.0, "Good": 3.0, "Good to Yielding": 2.5, "Good to Soft": 2.0, "Yielding": 1.5, "Yielding to Soft": 1.0,
    "Soft": 0.0, "Soft to Heavy": -0.5, "Heavy": -1.0, "Standard": 3.0, "Standard to Slow": 1.0, "Slow": 0.0,
}
GOING_CHANGE_DEFAULT = 3.0
GOING_FIRMNESS = {
    "Heavy": 1.0, "Soft": 2.0, "Yielding": 3.0, "Good to Soft": 4.0, "Good to Yielding": 4.5, "Good": 5.0, "Good to Firm": 6.0, "Firm": 7.0,
    "Standard": 5.0, "Standard to Slow": 3.0, "Slow": 2.0, "Fast": 6.0,
}
GOING_FIRMNESS_DEFAULT = 5.0

#: Words that tell a race type; jump words are tested first. Fixed values.
JUMP_WORDS = ("hurdle", "chase", "nh flat", "hunter", "bumper")
FLAT_WORDS = (
    "stakes", "handicap", "maiden", "group", "listed", "nursery", "conditions", "classified", "claiming", "selling", "auction", "fillies", "colts", "restricted",
)

POSITION_COLUMNS = ("pos", "position", "finish_position", "final_position", "place")
WINNER_COLUMNS = ("won", "win", "winner", "is_winner")
WINNER_TRUE = ("1", "True", "true", "Y", "yes", "Yes")
ODDS_SENTINELS = ("", "SCRATCHED", "N/A", "-", "nan", "NaN")

#: Parts of column names that tell results known only after a race. Fixed values.
LEAKAGE_PARTS = (
    "winning_distance", "sp_win_return", "ew_return", "betfair_win_return", "place_return", "betfair_lay_return", "place_lay_return", "ip_min", "ip_max",
    "pre_min", "pre_max", "betfair_sp", "industry_sp", "sp_fav", "betfair_rank", "betfair_place_sp", "tick_reduction", "tick_inflation",
    "pct_bsp_reduction", "pct_bsp_inflation", "placed_in_betfair_market",
)
LEAKAGE_NAMES = ("pos", "position")
#: The same but for the starting prices, which the older generation's features read.
RESULT_PARTS = tuple(x for x in LEAKAGE_PARTS if x not in ("betfair_sp", "industry_sp", "sp_fav"))

#: Identifiers and result columns that selection never offers to a model. Fixed values.
ID_COLUMNS = ("race_id", "horse", "race_datetime", "date_of_race", "time", "course", "track", "jockey", "trainer", "country", "betting_deadline")
SELECTION_LEAKAGE = (
    "pos", "place", "is_winner", "placed", "placed_in_betfair_market", "finishing_position_variance", "betfair_win_return", "sp_win_return", "ew_return",
    "place_return", "betfair_lay_return", "place_lay_return", "ip_min", "ip_max", "tick_reduction", "tick_inflation", "pct_bsp_reduction",
    "pct_bsp_inflation", "winning_distance", "betfair_place_sp", "num_places",
)
