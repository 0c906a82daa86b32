"""Signal relations of many repositories, derived from the test tables by rules that any SQL engine evaluates alike.

The test tables hold no source code, so routes, calls, hints and secrets are made from their keys: integer remainders and
CASE only. The same text runs in Spark (over data frames) and in the oracle (over views). ``seq`` is the order in which a
scan would have found the rows; it decides every "first seen" rule.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

# Fixed values of the made repositories; the moduli have no common factor with the 20 repositories.
DIRS = ("services/api", "services/worker", "packages/pds", "apps/web", "x/module/Admin", "lib", "src/auth")
PATHS = (
    "/admin/users",
    "/login",
    "/webhooks/stripe",
    "/upload",
    "/internal/jobs",
    "/health",
    "/users",
    "/checkout",
    "/xrpc/com.atproto.repo.getRecord",
    "/xrpc/app.bsky.feed.getTimeline",
    "/s/site",
    "/api/orders",
    "/debug",
    "/metrics",
    "/profile",
    "/grant",
    "/",
    "/token",
    "/import/file",
    "/audit",
    "/payment",
    "/callback",
    "/.well-known/x",
)
METHODS = ("GET", "POST", "PUT", "DELETE", "PATCH", "ANY", "GET")
AUTH = ("jwt", "oauth", "session_cookie", "login_required", "api_key", "bearer token", "mfa")
CONTROLS = ("bcrypt", "express-rate-limit", "csrf_token", "helmet", "zod", "audit_log", "kms", "totp", "passport", "rbac", "tls", "dompurify", "hashicorp_vault")
PROTOCOL = (
    "atproto_namespace:com.atproto",
    "atproto_lexicon:com.atproto.repo.getRecord",
    "atproto_xrpc_ref:app.bsky.feed.getTimeline",
    "atproto_service_note:pds",
    "atproto_service_edge:relay",
    "atproto_event_stream:firehose",
    "atproto_auth:session",
)
FRAMEWORK = ("controller:AdminController", "service:UserService", "laminas_routes")
SECRETS = ("JWT_SECRET", "STRIPE_WEBHOOK_SECRET", "SERVICE_API_KEY", "SESSION_SECRET", "PASSWORD_PEPPER", "ENCRYPTION_KEY", "DB_PASSWORD", "ADMIN_TOKEN", "FEATURE_FLAG_SECRET")
FAMILIES = ("auth", "service", "edge", "entrypoint", "protocol", "framework")


def pick(key: str, values: tuple[str, ...]) -> str:
    cases = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values[:-1]))
    return f"CASE {key} % {len(values)} {cases} ELSE '{values[-1]}' END"


def file_of(key: str) -> str:
    """Path of the made file of a key."""
    return (
        f"CASE WHEN {key} % 17 = 0 THEN 'models/user.py' ELSE concat(CASE WHEN {key} % 11 = 0 THEN 'tests' WHEN {key} % 13 = 0 THEN 'src/internal'"
        f" ELSE {pick(key, DIRS)} END, '/f', {key} % 5, {pick(key, ('.py', '.js', '.ts'))}) END"
    )


def line_of(key: str) -> str:
    return f"CASE WHEN {key} % 9 = 0 THEN NULL ELSE CAST({key} % 200 + 1 AS INT) END"


HINT = f"""
SELECT concat('r', event_id % 20) AS repo,
  CASE event_id % 11 WHEN 4 THEN CASE WHEN event_id % 20 % 4 < 2 THEN 'service' ELSE 'framework' END WHEN 5 THEN 'edge' WHEN 6 THEN 'entrypoint' WHEN 7 THEN 'protocol' WHEN 8 THEN 'framework' WHEN 10 THEN 'framework' ELSE 'auth' END AS family,
  CASE event_id % 11
    WHEN 4 THEN CASE WHEN event_id % 20 % 4 >= 2 THEN 'express' WHEN event_id % 13 = 0 THEN 'service_role:worker' ELSE concat('service_name:', {pick("event_id", ("api", "Worker", "pds"))}) END
    WHEN 5 THEN CASE WHEN event_id % 20 % 4 >= 2 THEN 'edge:none' ELSE {pick("event_id", ("edge:api->worker", "edge:API -> pds", "edge:bad"))} END
    WHEN 6 THEN {pick("event_id", ("entrypoint:http", "handler_visibility:internal", "handler_visibility:public"))}
    WHEN 7 THEN CASE WHEN event_id % 20 % 4 = 0 THEN {pick("event_id", PROTOCOL)} ELSE 'protocol:grpc' END
    WHEN 8 THEN CASE WHEN event_id % 20 % 4 = 2 THEN {pick("event_id", FRAMEWORK)} ELSE 'flask' END
    WHEN 9 THEN CASE WHEN event_id % 20 % 4 = 1 THEN {pick("event_id", ("service_name:gateway", "edge:gateway->api", "express"))} ELSE {pick("event_id", ("password", "express", "handler_type:internal_handler"))} END
    WHEN 10 THEN CASE WHEN event_id % 20 % 5 = 1 THEN {pick("event_id", CONTROLS)} ELSE 'react' END
    ELSE {pick("event_id", AUTH)} END AS hint,
  {file_of("event_id")} AS file, {line_of("event_id")} AS line, CAST(CASE WHEN event_id % 3 = 0 THEN 0.5 ELSE 0.85 END AS DOUBLE) AS confidence, event_id AS seq
FROM {{events}} WHERE event_id % 20 NOT IN (7, 19)
"""

#: Relation -> (its SQL, the tables it reads). Repositories 7 and 19 have no hints, 18 no routes, 5, 7 and 15 no datastores,
#: 7 and 15 no secrets; three more show what the others can't: quiet has nothing, plain a datastore alone, and caller a route
#: of two methods and a call alone.
RELATIONS: dict[str, tuple[str, str]] = {
    "route": (
        f"SELECT concat('r', page_id % 20) AS repo, {pick('page_id', PATHS)} AS path, {pick('page_id', METHODS)} AS method, {file_of('page_id')} AS file,"
        f" {line_of('page_id')} AS line, page_id AS seq FROM {{pages}} WHERE page_id % 20 <> 18 UNION ALL SELECT 'caller', '/orders', 'GET', 'src/caller.py',"
        f" CAST(7 AS INT), 4000000001 UNION ALL SELECT 'caller', '/orders', 'POST', 'src/caller.py', CAST(8 AS INT), 4000000002",
        "pages",
    ),
    "external_call": (
        f"SELECT concat('r', page_id % 20) AS repo, CASE WHEN page_id % 9 = 0 THEN concat('env://SVC_', page_id % 4) ELSE concat('https://h', page_id % 7,"
        f" '.example.com') END AS target, {file_of('page_id')} AS file, {line_of('page_id')} AS line, page_id AS seq FROM {{pages}} WHERE page_id % 3 = 0"
        f" AND page_id % 20 NOT IN (7, 15) UNION ALL SELECT 'caller', 'https://h.example.com', 'src/caller.py', CAST(9 AS INT), 4000000001",
        "pages",
    ),
    "database_hint": (
        f"SELECT concat('r', s_suppkey % 20) AS repo, {pick('s_suppkey', ('postgresql', 'mysql', 'mongodb', 'redis', 'sqlite', 'sql', 'redis'))} AS kind,"
        f" {file_of('s_suppkey')} AS file, {line_of('s_suppkey')} AS line, s_suppkey AS seq FROM {{supplier}} WHERE s_suppkey % 20 NOT IN (5, 7, 15) UNION ALL"
        f" SELECT 'plain', 'redis', 'lib/store.py', CAST(3 AS INT), 4000000001",
        "supplier",
    ),
    "hint": (HINT, "events"),
    "secret_hint": (
        f"SELECT concat('r', doc_id % 20) AS repo, CASE WHEN doc_id % 20 = 11 THEN 'JWT_SECRET' ELSE {pick('doc_id', SECRETS)} END AS name, {file_of('doc_id')}"
        f" AS file, {line_of('doc_id')} AS line, CAST(0.85 AS DOUBLE) AS confidence, doc_id AS seq FROM {{documents}} WHERE doc_id % 3 = 0"
        f" AND doc_id % 20 NOT IN (7, 15)",
        "documents",
    ),
    "repo": ("SELECT DISTINCT concat('r', doc_id % 20) AS repo FROM {documents} UNION ALL SELECT 'quiet' UNION ALL SELECT 'plain' UNION ALL SELECT 'caller'", "documents"),
}


@dataclass(frozen=True)
class Scan:
    """The signal relations of all repositories; every one has repo first and, but for repo, seq last."""

    repo: DataFrame
    route: DataFrame
    external_call: DataFrame
    database_hint: DataFrame
    hint: DataFrame
    secret_hint: DataFrame

    def with_hints(self, hint: DataFrame) -> Scan:
        return replace(self, hint=hint)


def load(spark: SparkSession, sf_dir: str) -> Scan:
    """The made relations of a data directory."""

    def relation(name: str) -> DataFrame:
        sql, table = RELATIONS[name]
        return spark.sql(sql, **{table: spark.read.parquet(f"{sf_dir}/{table}.parquet")})

    return Scan(*(relation(n) for n in ("repo", "route", "external_call", "database_hint", "hint", "secret_hint")))


def oracle_ctes() -> dict[str, str]:
    """The same relations as SQL over the test tables' views."""
    return {name: sql.format(**{table: table}) for name, (sql, table) in RELATIONS.items()}
