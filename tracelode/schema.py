"""Event schema, flag bits and thresholds: the one place for constants."""

from pyspark.sql import types as T

EVENT_COLUMNS = (
    "event_hash", "ts", "ingest_ts", "host", "source_id", "source_seq", "subject", "object", "action", "attributes", "template_hash", "raw", "flux_tags",
)
LONG_COLUMNS = ("source_seq", "flux_tags")
EVENT_SCHEMA = T.StructType([T.StructField(c, T.LongType() if c in LONG_COLUMNS else T.StringType()) for c in EVENT_COLUMNS])

# Flag bits and the words that set them.
ERROR, ATTACK, NETWORK, FILE_MOD, AUTH, AI, ANOMALY = 1, 2, 4, 8, 16, 32, 64
ERROR_WORDS = ("error", "err", "fail", "failed", "panic", "fatal", "exception", "stderr")
ATTACK_WORDS = (
    "powershell", "certutil", "whoami", "net user", "mimikatz", "vssadmin", "bcp", "curl", "wget", "chmod +x", "nc -e", "bash -i",
    "reg add", "rundll32", "wmic", "mshta", "cscript", "wscript", "cmd.exe",
)
NETWORK_ACTIONS = ("connect", "accept", "send", "recv", "bind", "listen", "socket", "http", "dns", "net")
FILE_ACTIONS = ("write", "unlink", "rename", "modify", "chmod", "chown", "create", "delete")
AUTH_WORDS = ("login", "auth", "token", "password", "credential", "sudo", "su", "privilege")

# Thresholds.
IDLE_SECONDS, MAX_TRACE_SECONDS = 1800, 86_400
SKETCH_SLOTS = 128
LSH_THRESHOLD = 0.5
PROBE_BELOW = 5
POSTING_CAP, COMMON_FLOOR, COMMON_SHARE = 10_000, 100, 0.001
PROVENANCE_SECONDS = 900
ANN_K, ANN_MIN_COSINE = 20, 0.5
CANDIDATE_CAP = 50
ROUND_BUDGET = 20_000
TAU_MEMBER, TAU_SEED, MAX_MEMBERSHIPS = 0.5, 0.8, 3
PROTOTYPE_WEIGHT, STRONG_MEMBER = 0.3, 0.7
WINDOW_SECONDS, HORIZON_SECONDS = 900, 48 * 3600
CANDIDATE_P, ATTRIBUTED_P, UNKNOWN_PRIOR = 0.3, 0.9, 0.3
CLASSIFIER_WEIGHT, TECHNIQUE_WEIGHT = 0.7, 0.3
TOKEN_RETENTION = 4096
RESULT_CAP = 10_000
ENTROPY_LIMIT, RATIO_LIMIT, ANOMALY_SCORE = 7.1, 0.92, 0.85
EDGE_DEFAULT, EDGE_ANOMALOUS = 0.25, 0.7
GENESIS = "0" * 64

# Anomaly of (action, object type) edges of a process.
EDGE_SCORES = {
    ("fork", "process"): 0.01, ("exec", "process"): 0.05, ("read", "file"): 0.01, ("write", "file"): 0.02, ("connect", "socket"): 0.05,
    ("send", "socket"): 0.02, ("recv", "socket"): 0.02, ("inject", "process"): 0.95, ("write", "memory"): 0.90, ("modify", "registry"): 0.80,
    ("connect", "raw_socket"): 0.85, ("unlink", "log"): 0.90,
}

# Attribute names of AI calls in order of precedence.
AI_ALIASES = {
    "provider": ("gen_ai.system", "ai.provider", "llm.provider", "ai.model.provider"),
    "model": ("gen_ai.request.model", "gen_ai.response.model", "ai.model.id", "llm.model", "model"),
    "prompt": ("gen_ai.prompt", "ai.prompt", "prompt", "gen_ai.request.prompt"),
    "completion": ("gen_ai.completion", "ai.response", "response", "gen_ai.response.completion"),
    "input_tokens": ("gen_ai.usage.input_tokens", "gen_ai.usage.prompt_tokens", "ai.usage.promptTokens", "llm.token_count.prompt"),
    "output_tokens": ("gen_ai.usage.output_tokens", "gen_ai.usage.completion_tokens", "ai.usage.completionTokens", "llm.token_count.completion"),
    "total_tokens": ("gen_ai.usage.total_tokens", "ai.usage.totalTokens", "llm.token_count.total"),
}
