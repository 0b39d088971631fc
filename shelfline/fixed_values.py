"""Constants, word lists, patterns and labels whose exact value decides a result.

They are data, not logic; everything is exposed as a default that callers may override.
"""

# --- price tolerance and horizons -------------------------------------------------------
SAME_PRICE_TOL = 0.005
SALE_WINDOW_DAYS = 35
RESOLVE_MIN_DAYS = 21
MAX_GAP_DAYS = 7
SALE_CONFIRM_DAYS = 21
CARRY_DAYS = 3
LABEL_CLIP = 0.8
OUTAGE_FRACTION = 0.5
SENSITIVITY_WINDOWS = (14, 21, 35, 60)
JUMP_THRESHOLDS = (0.2, 0.5, 0.8, 1.0, 2.0)

# --- file names and headers --------------------------------------------------------------
# (pattern, meaning of the groups); the first pattern that matches decides
FILE_DATE_PATTERNS = (
    (r"(\d{4})-(\d{2})-(\d{2})", "ymd"),
    (r"(\d{4})(\d{2})(\d{2})_\d{4,6}", "ymd"),
    (r"(\d{2})\.(\d{2})\.(\d{4})", "dmy"),
    (r"products-?(\d{1,2})-(\d{1,2})$", "md"),
)
NAME_HEADERS = ("product_name", "name", "isim", "ad", "Name", "Ürün Adı")
PRICE_HEADERS = ("price", "Price", "fiyat", "Fiyat", "product_price", "price (TL)", "price_tl")
HEADER_RENAMES = {
    "product-id": "product_id",
    "kategori": "category",
    "eski_fiyat": "old_price",
    "tarih": "source_date",
}
PER_KG_SUFFIX = r"_1kg$"
TRUNCATION_MARK = "..."
URL_ID_PATTERN = r"-(\d+)-p/?$"

# --- text folding --------------------------------------------------------------------------
FOLD_FROM, FOLD_TO = "çğıöşü", "cgiosu"
FOLD_WIDE_FROM, FOLD_WIDE_TO = "çğıöşüâîû", "cgiosuaiu"
# ordered (pattern, replacement) pairs of the name normaliser, Java replacement syntax
UNIT_REWRITES = (
    (r"(\d),(\d)", "$1.$2"),
    (r"(\d)\s*[x\*]\s*(\d)", "$1x$2"),
    (r"\b(gr|grm|gram)\b\.?", "g"),
    (r"\b(lt|litre)\b\.?", "l"),
    (r"\bml\b\.?", "ml"),
    (r"\b(adet|ad)\b\.?", "adet"),
    (r"(\d)\s+(g|kg|ml|l|cl|adet)\b", "$1$2"),
    (r"'\s*(li|lu)\b", "li"),
    (r"(\d)\s*(li|lu)\b", "$1li"),
)
PACK_SIZE = r"(\d+(?:\.\d+)?)\s*(kg|gr|g|mg|lt|l|ml|cl)\b"
PACK_MULTI = r"(\d+)\s*[x\*]\s*" + PACK_SIZE
PACK_PIECES = r"(\d+)\s*(?:'\s*)?(li|lu|lik|luk|adet|ad)\b"
UNIT_BASE = {
    "kg": ("g", 1000.0), "g": ("g", 1.0), "gr": ("g", 1.0), "mg": ("g", 0.001),
    "l": ("ml", 1000.0), "lt": ("ml", 1000.0), "ml": ("ml", 1.0), "cl": ("ml", 10.0),
}
GENERIC_WORDS = (
    "adet", "paket", "yeni", "kg", "g", "ml", "l", "li", "koli", "ekonomik", "avantaj", "firsat",
    "eko", "boy", "buyuk", "kucuk", "ve", "ile", "icin",
)
UNIT_BASIS = {"g": "TRY/kg", "ml": "TRY/l", "piece": "TRY/piece", "none": "none"}

# --- rename classes --------------------------------------------------------------------------
PAIR_IDENTICAL = "identical"
PAIR_CASE = "case/whitespace/Turkish chars"
PAIR_FORMAT = "unit/number formatting"
PAIR_ORDER = "word order"
PAIR_ADDED = "words added (e.g. brand/descriptor)"
PAIR_REMOVED = "words removed"
PAIR_REWRITE = "rewrite (words added and removed)"
SCORE_BIN_EDGES = (0.0, 0.3, 0.5, 0.7, 0.9, 1.0001)
SCORE_BIN_LABELS = ("<0.3", "0.3-0.5", "0.5-0.7", "0.7-0.9", "0.9-1.0")

# --- linking -------------------------------------------------------------------------------
MAX_PRICE_RATIO = 1.25
SHORT_GAP_DAYS = 14
NAME_MIN_SHORT_GAP = 70
NAME_MIN_LONG_GAP = 85
BLOCK_TOP_IDS = 25
BLOCK_TOP_NAMES = 75
VARIANT_RATIO = 80
METHOD_RANK = {
    "1_exact": 0, "3b_truncated_prefix": 1, "3c_normalized": 2, "3d_word_order": 3,
    "5_handover_short_gap": 4, "5_handover_long_gap": 5, "6_own_series": 6,
}

# --- categories ------------------------------------------------------------------------------
CATEGORY_TO_COICOP = {
    "Meyve ve Sebze": "01", "Et ve Tavuk": "01", "Süt, Kahvaltılık, Sark.": "01", "Temel Gıda": "01",
    "İçecekler": "01", "Atıştırmalıklar": "01", "Bebek Ürünleri": "13", "Kişisel Bakım": "13",
    "Deterjan ve Temizlik": "05", "Ev ve Yaşam": "05", "Kitap, Kırtasiye": "09", "Petshop": "09",
}
COICOP_WEIGHTS = {"01": 24.44, "05": 7.92, "09": 4.34, "13": 4.49}

# --- calendar ------------------------------------------------------------------------------
HOLIDAYS_2026 = (
    "2026-01-01", "2026-03-19", "2026-03-20", "2026-03-21", "2026-03-22", "2026-04-23",
    "2026-05-01", "2026-05-19", "2026-05-26", "2026-05-27", "2026-05-28", "2026-05-29",
    "2026-05-30", "2026-07-15", "2026-08-30", "2026-10-28", "2026-10-29",
)
DATA_TARGET_DAYS = (1, 14, 15, 16)
WEEKDAY_LABELS = ("Pzt", "Sal", "Çar", "Per", "Cum", "Cmt", "Paz")

# --- features ------------------------------------------------------------------------------
FEATURE_GROUPS = {
    "lags": ["price_lag_1", "price_lag_7", "price_lag_15", "price_lag_30"],
    "cyclic": ["dow_sin", "dow_cos", "month_sin", "month_cos", "dom_sin", "dom_cos", "is_1st", "is_15th",
               "is_16th", "is_month_end", "days_to_month_end", "is_holiday"],
    "usd_try": ["usd_try_rate", "usd_try_rate_change", "usd_try_change_7d", "usd_try_change_30d"],
    "oil": ["brent_try", "brent_try_change_7d", "brent_try_change_30d"],
    "tuik": ["tuik_food_mom_last", "tuik_headline_mom_last", "tuik_food_3m_cum", "days_since_tuik_release"],
    "rolling": ["price_7d_mean", "price_7d_std", "price_30d_mean", "price_momentum_7d", "ratio_lag1_mean30",
                "days_since_change", "n_changes_30d", "n_changes_60d", "last_change_size"],
    "sale": ["shelf_price_lag1", "shelf_to_base_lag1", "on_sale_lag1", "sale_depth_lag1",
             "days_in_sale_lag1", "n_sale_days_60d"],
    "unit_price": ["log_unit_price_lag1", "rel_unit_price_lag1"],
    "cross_section": ["store_reprice_share_1d", "store_reprice_share_7d", "cat_reprice_share_1d",
                      "cat_reprice_share_7d"],
    "web_index": ["web_cat_infl_30d", "web_store_infl_30d"],
}
CATEGORICAL_FEATURES = ("coicop", "unit_basis")
FEATURE_KEYS = ("segment_id", "series_id", "date", "observed", "usable_target", "is_sale_day", "in_outage",
                "is_target_spec", "is_target_data", "shelf_price", "base_price", "target_price",
                "target_pct_change")
ABLATION_RUNS = {
    "run1_price_lag_1": (["price_lag_1"], False),
    "run2_lags_cyclic": (["lags", "cyclic"], False),
    "run3_+usd_try": (["lags", "cyclic", "usd_try"], False),
    "run4_spec_full (+tuik, rolling)": (["lags", "cyclic", "usd_try", "tuik", "rolling"], True),
    "run5_all (+oil, sale, unit price, cross-section, web index)": (list(FEATURE_GROUPS), True),
}
FEATURE_SETS = {
    "1_price_history": (["lags", "rolling", "sale"], False),
    "2_price_history+usd_try": (["lags", "rolling", "sale", "usd_try"], False),
    "3_all_features": (list(FEATURE_GROUPS), True),
}

# --- calendar rules and back-testing -------------------------------------------------------------
STORE_BEST_CANDIDATES = ("1st_only", "dom_top2", "dom_top4", "dom_top4_shrunk", "dow_top1", "dow_top2",
                         "dom_top2+dow_top1", "pilot_1_14_15_16_hol")
STORE_BEST_DEFAULT = "pilot_1_14_15_16_hol"
MIN_PRODUCTS, MIN_TRAIN_DAYS, MIN_TEST_DAYS = 50, 20, 5
GATE_BUDGET = 4 / 30
GATE_MIN_ROWS = 200
SHRINK_STRENGTH = 2.0
GATE_FEATURES = ("dom", "dow", "hist_dom_rel", "hist_dow_rel", "hist_dom_n", "rate_lag1", "rate_7d",
                 "is_holiday", "days_to_month_end")
WEEKLY_MONTHLY_BUDGETS = ((1, 4), (2, 9), (3, 13), (4, 17))
FAMILY_BUDGETS = (0.15, 0.30, 0.45)
BUDGET_SLACK = 0.02
TRIGGER_BUDGET, TRIGGER_QUANTILE = 0.17, 0.9
MIN_STORE_DAYS = 30
BOOTSTRAP_REPS = 1000

# --- forecasting ----------------------------------------------------------------------------
EARLY_STOP_DAYS, MAX_TREES, EARLY_STOP_ROUNDS, SEED = 14, 2000, 100, 42
THRESHOLD_GRID = tuple(round(0.2 + 0.05 * i, 2) for i in range(17))
ROW_CLASSES = ("real", "label_b3", "diverge", "flat")
HALF_PRICE_FROM = "2026-09-18"
CHANGED_PRICE_MIN = 0.01
