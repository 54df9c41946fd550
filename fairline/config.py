"""Fixed values. Results depend on them, so they are stated once, here, as plain text."""

# Walk-forward fit.
REFIT_DAYS = 7
MIN_TRAIN_MATCHES = 200
HALF_LIFE_DAYS = 180.0
RIDGE = 0.05
MAX_GOALS = 12
MAX_CORNERS = 25
SIGNAL_WEIGHT = 0.5
MIN_SHOT_ROWS = 100
RHO_BOUND = 0.2

# Fusing the two forecasts.
MARKET_WEIGHT = 0.9
DEVIG = "power"
DEVIG_METHODS = ("proportional", "power", "shin")

# Selecting picks.
MIN_CONFIDENCE = 0.75
MAX_IMPLIED_RESID = 0.02
BEST_ODDS_MIN = 1.60
BEST_ODDS_MAX = 2.20
PICK_BANDS = (("safe", 1.30, 1.60), ("main", 1.60, 2.20), ("value", 2.20, 3.00))
PICK_DAYS = 3
ACCA_LEGS = 4
ACCA_MAX_LEGS = 6
ACCA_TARGET_ODDS = 3.0
PARLAY_SIZES = (2, 3, 4)
PARLAY_POOL = 8
CARD_FLOOR = 0.55

# Calibration.
CALIBRATION_BINS = 150
CALIBRATION_MIN_SAMPLES = 2000
CALIBRATION_CLIP = 1e-4
CALIBRATION_SHRINK = 0.0
CALIBRATION_FOLDS = 5

# Reliability.
BAND_EDGES = (0.30, 0.40, 0.45, 0.50, 0.60, 0.70, 0.75, 0.80, 0.85, 0.90, 0.95,
              0.97, 0.98, 0.99, 1.01)
CEILING_FLOOR = 0.50
MIN_BAND_SAMPLE = 200
MAX_OVERSTATEMENT = 0.02
WILSON_Z = 1.96
ECE_BINS = 20

# Value backtest.
BACKTEST_MIN_TRAIN = 150
ODDS_MIN = 1.60
ODDS_MAX = 2.50
MIN_EDGE = 0.03
BACKTEST_STAKE = 10.0
REFIT_ROWS = 5
BOOTSTRAP_SAMPLES = 5000
BACKTEST_MARKETS = ("1x2", "ou2.5")
BACKTEST_MAX_GOALS = 10
SHRINKAGE_GAMES = 5.0
SWEEP_BANDS = ((1.70, 2.00), (1.60, 2.50), (1.50, 3.00), (1.01, 99.0))
FILTER_MAX_EDGE = 0.08
FILTER_EXCLUDED = ("FL1",)
EQUITY_POINTS = 400
PERIODS = 4
EDGE_BUCKETS = ((0.03, 0.05), (0.05, 0.08), (0.08, 0.12), (0.12, 1.0))
RANDOM_SAMPLES = 200

# Ledger.
LEDGER_STAKE = 1.0
POSTPONEMENT_DAYS = 7
OVERDUE_DAYS = 14
DEFAULT_BAND = "main"

# Name matching.
FUZZY_THRESHOLD = 0.87

# Selection catalogue.
TOTAL_LINES = (0.5, 1.5, 2.5, 3.5, 4.5)
TEAM_LINES = (0.5, 1.5, 2.5)
CORNER_LINES = (7.5, 8.5, 9.5, 10.5, 11.5)
GROUPS = {
    "1x2": "1X2",
    "dc": "Double chance",
    "btts": "Both teams to score",
    "ou": "Total goals",
    "tt": "Team goals",
    "hcp": "Handicap",
    "dnb": "Draw no bet",
    "corners": "Corners",
}
