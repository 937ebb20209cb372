"""Fixed values that results depend on."""

# Sector dimension: name, two-digit code prefix, moving-average rows, momentum lag rows.
SECTORS = [
    ("energy", "10", 45, 90),
    ("materials", "15", 45, 90),
    ("industrials", "20", 50, 100),
    ("cons_discretionary", "25", 40, 80),
    ("cons_staples", "30", 60, 120),
    ("healthcare", "35", 35, 70),
    ("financials", "40", 30, 60),
    ("it", "45", 25, 50),
    ("telecoms", "50", 55, 110),
    ("utilities", "55", 60, 120),
    ("re", "60", 50, 100),
]
DEFAULT_SECTOR = "utilities"

# Identifier columns, the untouched target, and the accepted date columns.
ID_COLUMNS = ["id", "gvkey", "iid", "excntry", "tic", "cusip", "conm"]
TARGET_COLUMN = "ret_eom"
DATE_COLUMNS = ["datadate", "date"]

# Feature categories: return tags first, then keywords in order; first hit wins.
RETURN_TAGS = ["ret_", "resff3", "rmax", "seas_"]
CATEGORY_KEYWORDS = [
    ("turnover", "liquidity"), ("dollar_vol", "liquidity"), ("volume", "liquidity"),
    ("bid", "microstructure"), ("ask", "microstructure"), ("bidsk", "microstructure"),
    ("amih", "microstructure"),
    ("me", "size"), ("market_equity", "size"), ("size", "size"),
    ("prc", "price"), ("price", "price"),
    ("bm", "value"), ("be_me", "value"), ("pb", "value"), ("intrinsic_value", "value"),
    ("bte_mev", "value"),
    ("roe", "quality"), ("roa", "quality"), ("gp_at", "quality"), ("gp_atl", "quality"),
    ("f_score", "quality"), ("o_score", "quality"),
    ("gr1", "growth"), ("gr2", "growth"), ("gr3", "growth"), ("growth", "growth"),
    ("lev", "leverage"), ("debt", "leverage"), ("netdebt", "leverage"),
    ("vol", "risk"), ("beta", "risk"), ("iskew", "risk"), ("coskew", "risk"), ("corr_", "risk"),
]
CATEGORIES = [
    "returns", "size", "price", "liquidity", "value", "quality",
    "growth", "leverage", "risk", "microstructure", "other",
]
LOG1P_CATEGORIES = ["size", "price", "liquidity", "microstructure"]
SIGNED_LOG_CATEGORIES = ["growth", "leverage"]

# Profile quantiles, per-month scaling guard and clip.
PROFILE_PROBS = {"median": 0.5, "q0005": 0.005, "q01": 0.01, "q99": 0.99, "q995": 0.995}
MAD_FLOOR = 1e-9
FINAL_CLIP = 8.0
SKETCH_SIZE = 4096  # accuracy parameter of the mergeable quantile sketches
SAMPLE_ROWS_PER_CHUNK = 4000
CHUNK_ROWS = 100_000
SAMPLE_SEED = 42
NUMERIC_SHARE = 0.9

# Volatility forecast: rows needed, rows used.
VOL_MIN_ROWS = 500
VOL_MAX_ROWS = 750

# Candidate selection: share per side and score weights.
SIDE_RATIO = 0.15
W_MOMENTUM, W_TREND, W_VOLATILITY = 0.5, 0.3, 0.2
# Optional universe thresholds (off unless asked for).
VOL_BAND, MIN_MARKET_CAP, MIN_LIQUIDITY = (0.05, 0.95), 100.0, 0.001

# Portfolio construction.
ALGO_WEIGHT, ML_WEIGHT = 0.6, 0.4
HISTORY_YEARS, HISTORY_MIN_BARS = 3, 30
NULL_LIKE = ["nan", "None", "", "NaN"]

# Dense model features: bars O, H, L, C, V in this order, windows in calendar steps.
BAR_COLUMNS = ["open", "high", "low", "close", "volume"]
MA_WINDOWS = [5, 10, 20, 30]
PAD = 29
MISSING_CELL = -1234.0
CLOSE_FEATURES = [15, 16, 17, 18, 19]

# Bar derivation parameter sets.
# price scale, overnight share, gap cap, intraday share, volatility factor, counter-side factor,
# volatility floor and cap, base volume, volume scale, volume bounds, return factor
BAR_SETS = {
    "company": dict(price_scale=0.2, overnight=0.1, gap_cap=0.05, intraday=0.6, vol=0.3, counter=0.3,
                    vol_floor=0.01, vol_cap=0.1, base_volume=200000.0, volume_scale=0.2,
                    volume_lo=50000.0, volume_hi=5000000.0, volume_ret=0.1, volume_ret_alone=0.15),
    "transform": dict(price_scale=0.5, overnight=0.3, gap_cap=None, intraday=0.7, vol=0.5, counter=0.5,
                      vol_floor=None, vol_cap=None, base_volume=500000.0, volume_scale=0.5,
                      volume_lo=10000.0, volume_hi=10000000.0, volume_ret=0.2),
    "improved": dict(price_scale=0.3, overnight=0.2, gap_cap=None, intraday=1.0, vol=0.4, counter=0.3,
                     vol_floor=None, vol_cap=None, base_volume=300000.0, volume_scale=0.3,
                     volume_lo=10000.0, volume_hi=5000000.0, volume_ret=0.15),
}
BASE_PRICE = 50.0

# Text preparation.
MIN_TEXT, FORMAT_TEXT = 50, 2000  # the second is for callers that want the cut
SENTIMENT_BANDS = [(0.2, "Strong Positive"), (0.05, "Positive"), (-0.05, "Neutral"), (-0.2, "Negative")]
SENTIMENT_FLOOR = "Strong Negative"

# Histogram edges for predictions.
PREDICTION_EDGES = [-30.0, -20.0, -10.0, 0.0, 5.0, 10.0, 15.0]

# Default sentiment word lists (own choice; pass others to the lexicon scorer).
POSITIVE_WORDS = ["gain", "gains", "growth", "profit", "profits", "strong", "improve", "improved", "increase", "success"]
NEGATIVE_WORDS = ["loss", "losses", "decline", "risk", "risks", "weak", "impair", "impaired", "decrease", "failure"]
SEGMENT_CHARS = 512
