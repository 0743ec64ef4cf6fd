"""Declared schemas of the platform's tables (Spark DDL). JSON documents are strings until they are typed with from_json."""

USERS = "id string, username string, is_admin boolean, org_id string, org_role string, org_access string, last_login_at timestamp, created_at timestamp"
ORGANIZATIONS = "id string, name string, created_at timestamp"
ACCESS_GRANTS = "user_id string, kind string, item_id string, level string"
BOTS = "id string, user_id string, org_id string, data string, updated_at timestamp"
DOCUMENTS = "id string, agent_id string, skill_id string, parent_id string, chunk_index int, title string, content string, raw_content string, normalized boolean, source_type string, source_url string, created_at timestamp"
CHAT_SESSIONS = "id string, agent_id string, source string, branch_id string, messages string, started_at timestamp, updated_at timestamp"
DATA_TABLES = "id string, org_id string, name string, columns string, updated_at timestamp"
DATA_TABLE_ROWS = "id string, table_id string, data string, written_by string, created_at timestamp"
LLM_USAGE = "id long, at timestamp, org_id string, user_id string, source string, item_type string, item_id string, model string, input_tokens int, output_tokens int, cost_usd decimal(18,6), charged_usd decimal(38,12)"
ERROR_LOG = "id long, agent_id string, source string, message string, context string, created_at timestamp"
AUTOMATION_RUNS = "id string, automation_id string, org_id string, mode string, source string, status string, resume_at timestamp, heartbeat_at timestamp, reclaims int, state string, started_at timestamp, finished_at timestamp"

TABLES = {
    "users": USERS, "organizations": ORGANIZATIONS, "access_grants": ACCESS_GRANTS, "bots": BOTS, "documents": DOCUMENTS, "chat_sessions": CHAT_SESSIONS,
    "data_tables": DATA_TABLES, "data_table_rows": DATA_TABLE_ROWS, "llm_usage": LLM_USAGE, "error_log": ERROR_LOG, "automation_runs": AUTOMATION_RUNS,
}

#: Columns of JSON text and what they are typed to on read.
JSON_COLUMNS = {
    ("chat_sessions", "messages"): "array<struct<role:string,content:string>>",
    ("data_tables", "columns"): "array<struct<key:string,name:string,type:string>>",
    ("data_table_rows", "data"): "map<string,string>",
    ("bots", "data"): "struct<name:string,basePrompt:string,tables:array<string>,skills:array<string>,dlp:struct<creditCard:boolean,israeliId:boolean>,crawlConfig:struct<urls:array<string>,maxPages:int,lastCrawledAt:string>>",
}
