"""Values every engine must share for the results to be equal.

Fixed values: word lists, lookup tables, patterns, formats and constants. They
are data, not logic; nothing else in the package repeats them.
"""

from http import HTTPStatus

# Access-log line and its timestamp.
LOG_PATTERN = r'(\S+) .* \[([^\]]+)\] "([^"]+)" (\d{3}) (\d+|-)'
LOG_TIME_PATTERN = r"(\d{2}/\w{3}/\d{4}:\d{2}:\d{2}:\d{2})"
LOG_TIME_FORMAT = "dd/MMM/yyyy:HH:mm:ss"
ISO_TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"
RAW_COLUMNS = ["host", "timestamp", "request", "response", "bytes"]

# Host classification.
IPV4_PATTERN = r"^\d{1,3}(\.\d{1,3}){3}$"
TLD_CATEGORIES = {
    "net": "network",
    "com": "commercial",
    "org": "organisation",
    "edu": "education",
    "gov": "government",
    "int": "international",
    "mil": "military",
}
MAIN_VISITOR_TYPES = [
    "commercial", "country", "education", "government", "network", "unknown",
]
OTHER_COUNTRY = "other_country"
NON_COUNTRY = "non_country"

# Request classification.
UNKNOWN = "UNKNOWN"
PROTOCOL_TEXT = "HTTP/1.0"
HTTP_METHODS = [
    "GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS", "TRACE", "CONNECT",
]
IMAGE_TYPES = ["gif", "jpg", "jpeg", "tiff", "png", "bmp", "xbm", "eps", "art", "ps"]
AV_TYPES = ["wav", "avi", "mp3", "wma", "mpg", "ksc"]
FILE_TYPES = [
    "doc", "rtf", "xls", "txt", "bak", "xb", "pdf", "sta", "bps", "new", "zip",
    "bad", "out", "orig", "dat", "lists",
]
PAGE_TYPES = ["html", "pl", "htm", "map", "perl", "dec", "software"]
DYNAMIC_ENDINGS = ["pl", "cgi", "perl"]

# Response classification.
RESPONSE_CLASSES = {
    "1": "informational",
    "2": "successful",
    "3": "redirection",
    "4": "client error",
    "5": "server error",
}
STATUS_PHRASES = {status.value: status.phrase for status in HTTPStatus}
UNKNOWN_STATUS_PHRASE = HTTPStatus.NOT_FOUND.phrase

# Bucket lengths in minutes, and per frequency the lag and window
# lengths in rows.
FREQ_MINUTES = {"1m": 1, "5m": 5, "15m": 15}
LAGS = {"1m": [1, 2, 3, 5, 15], "5m": [1, 2, 3, 6], "15m": [1, 2, 3]}
WINDOWS = {"1m": [5, 15, 30], "5m": [6, 12, 24], "15m": [3, 6, 12]}
ENTROPY_EPSILON = 1e-12
PAYLOAD_EPSILON = 1e-6

# Columns of the feature table, in output order.
TARGETS = ["y_req_t1", "y_bytes_imp_t1"]
GAP_FLAG = "flag_data_gap"
FEATURE_COLUMNS = [
    "timestamp",
    "y_req_t1", "y_bytes_imp_t1",
    "y_req", "y_bytes_imp",
    "bytes_missing_rate", "bytes_all_missing",
    "error_rate", "server_error_rate", "redirection_rate",
    "dynamic_rate", "commercial_rate", "unknown_rate",
    "avg_path_depth",
    "country_nunique", "dir_nunique", "method_nunique",
    "top_country_share", "endpoint_entropy",
    "hour", "weekday", "is_weekend",
    "sin_hour", "cos_hour", "sin_weekday", "cos_weekday",
    "flag_data_gap",
]
HISTORY_COLUMNS = [
    "y_req", "y_bytes_imp", "bytes_missing_rate",
    "error_rate", "top_country_share", "endpoint_entropy",
]
SHORT_FEATURE_LIST = [
    "hour", "weekday", "is_weekend", "flag_data_gap", "error_rate",
    "avg_path_depth", "country_nunique",
]
ROW_CORRELATION_COLUMNS = [
    "bytes_imputed", "reqpathdepth", "requrllength", "visitor_type_freq",
    "country_freq", "hour", "response", "is_commercial", "is_weekend", "is_dynamic",
]
BUCKET_CORRELATION_COLUMNS = [
    "y_req_t1", "y_bytes_imp_t1", "y_req", "y_bytes_imp", "bytes_missing_rate",
    "error_rate", "server_error_rate", "redirection_rate", "dynamic_rate",
    "commercial_rate", "unknown_rate", "avg_path_depth", "country_nunique",
    "dir_nunique", "method_nunique", "top_country_share", "endpoint_entropy",
    "hour", "weekday",
]

# Profiling, hold-out and metric constants.
SUSPECT_MISSING_RATE = 0.2
FENCE_FACTOR = 1.5
HISTOGRAM_BINS = 100
SAMPLE_ROWS = 10000
SAMPLE_SEED = 42
TOP_COUNTRIES = 15
TOP_RESOURCES = 20
FOLDS = 5
HOLD_OUT_DATE = "1995-08-12 00:00:00"
MACHINE_EPSILON = 2.220446049250313e-16
METRIC_COLUMNS = ["Model_Type", "Target", "Timeframe", "RMSE", "MSE", "MAE", "MAPE"]

# Boosted-tree budgets (rounds, learning rate, depth).
LOG_TARGET_TREES = {"rounds": 1000, "rate": 0.02, "depth": 8, "patience": 50}
RAW_TARGET_TREES = {"rounds": 1000, "rate": 0.03, "depth": 5, "patience": 50}

# Scaling policy and cost report.
PEAK_SERVERS = 3.5
SCALE_OUT_WAIT = 2
COOLDOWN = 5
STABLE_ROWS = 5
POLICY_UTILISATION = 0.7
REPLAY_UTILISATION = 0.3
UNIT_COST = 100
OVERLOAD_PENALTY = 1000
