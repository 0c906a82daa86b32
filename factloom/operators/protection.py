"""What a repository holds and what guards it: assets, and controls that are present or missing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.expressions import first_values, has_any, location, low_quality_ext, rank_of, sorted_set
from factloom.operators.chains import text
from factloom.operators.signals import family
from factloom.sources.adapters import FAMILIES, Scan
from factloom.sources.staged import settled

# Asset kinds with name, criticality, and the parts of secret names, route paths and file paths that tell them.
ASSETS = (
    (
        "session",
        "Authentication tokens / session material",
        "critical",
        ("jwt_secret", "session_secret", "cookie_secret", "auth_secret", "refresh_secret", "signing_key"),
        ("/login", "/signin", "/token", "/oauth", "/session", "/refresh", "/logout"),
        ("auth/", "session/", "/jwt"),
    ),
    (
        "credentials",
        "User credentials at rest",
        "critical",
        ("password_pepper", "hash_secret"),
        ("/password", "/signup", "/register", "/reset-password", "/forgot"),
        ("models/user", "models/account", "entities/user", "entities/account", "user_repository", "auth/password"),
    ),
    (
        "payment",
        "Payment / billing records",
        "critical",
        ("stripe", "paypal", "braintree", "adyen", "billing_key"),
        ("/payment", "/checkout", "/billing", "/invoice", "/subscription", "/charge"),
        ("models/payment", "models/invoice", "models/order", "entities/payment", "entities/invoice", "entities/order", "billing/"),
    ),
    (
        "user_pii",
        "User PII / profile data",
        "high",
        (),
        ("/users", "/user/", "/profile", "/account", "/me", "/contacts", "/address"),
        ("models/user", "models/profile", "models/contact", "entities/user", "entities/profile", "user_repository", "user_service"),
    ),
    (
        "internal_secret",
        "Internal service / API secrets",
        "high",
        ("api_key", "private_key", "webhook_secret", "signing_secret", "service_token", "admin_token", "internal_key", "encryption_key", "master_key", "deploy_key"),
        (),
        ("vault/", "kms/", "/keys/"),
    ),
    ("audit_log", "Audit / security logs", "medium", (), ("/audit", "/security/log", "/events"), ("audit/", "/audit_log", "security/log", "logs/security")),
    ("configuration", "Security-relevant configuration", "medium", ("config_signing", "feature_flag_secret"), (), (".env", "config/secrets", "secrets.yml", "secrets.yaml", "config/security")),
)
# Pattern of a secret's name, kind, name, criticality; the first that fits counts.
SECRET_ASSETS = (
    ("jwt|session|cookie|refresh|auth_secret", "session", "Auth/session secret", "critical"),
    ("stripe|paypal|braintree|adyen", "payment", "Payment processor secret", "critical"),
    ("webhook|signing|hmac", "internal_secret", "Webhook / signing secret", "high"),
    ("api[_-]?key|service[_-]?token|admin[_-]?token|deploy[_-]?key", "internal_secret", "API / service token", "high"),
    ("private[_-]?key|encryption[_-]?key|master[_-]?key", "internal_secret", "Cryptographic key material", "critical"),
)
# Kind, name, strength and pattern of the controls.
CONTROLS = (
    ("authentication", "Password hashing (bcrypt/argon2/scrypt)", "strong", r"\b(bcrypt|argon2|scrypt|pbkdf2)\b"),
    ("authentication", "JWT verification", "moderate", r"jwt[._-]?(verify|decode|sign)|jsonwebtoken"),
    (
        "authentication",
        "Auth middleware / guards",
        "moderate",
        r"\b(passport|require[_-]?auth|requireauth|@login_required|@auth\.login_required|authenticate_user|ensureauthenticated|@auth_required|isauthenticated)\b",
    ),
    ("mfa", "Multi-factor authentication", "strong", r"\b(mfa|totp|2fa|webauthn|fido2|otp)\b"),
    ("authorization", "Role / permission checks", "moderate", r"\b(haspermission|require_role|requireroles?|@permission_required|@requires_role|hasrole|abilities|policy_check|authorize\()\b"),
    ("rbac", "Role-based access control", "moderate", r"\b(rbac|role_based|access_control_list|acl_check)\b"),
    ("input_validation", "Schema validation library", "moderate", r"\b(zod|joi|yup|ajv|pydantic|marshmallow|cerberus|validator\.is|class-validator)\b"),
    ("rate_limiting", "Rate limiting middleware", "moderate", r"\b(rate[_-]?limit|express-rate-limit|slowapi|throttle|bottleneck|rack-attack)\b"),
    ("csrf_protection", "CSRF protection", "moderate", r"\b(csurf|csrf[_-]?token|csrf_protect|csrfprotect|samesite=(strict|lax))\b"),
    ("encryption_in_transit", "TLS / HTTPS / mTLS", "moderate", r"\b(https://|tls|mtls|sslcontext|ssl_ctx|forcessl|hsts)\b"),
    ("encryption_at_rest", "At-rest encryption / KMS", "moderate", r"\b(kms|envelope_encrypt|aes-256|fernet|libsodium|sealedbox)\b"),
    ("audit_logging", "Audit / security logging", "moderate", r"\b(audit_log|security_event|log_security|audit\.log|securityaudit|logaudit)\b"),
    ("security_headers", "Security headers (helmet/secure)", "moderate", r"\b(helmet|secure-headers|csp|content_security_policy|x-frame-options)\b"),
    ("output_encoding", "Output encoding / sanitization", "moderate", r"\b(escape_html|sanitize-html|dompurify|bleach\.clean|markupsafe)\b"),
    ("secret_management", "Vault / secret manager", "strong", r"\b(hashicorp[_-]?vault|aws_secretsmanager|gcp_secretmanager|azure_keyvault|doppler)\b"),
)
SENSITIVE = ("credentials", "session", "user_pii", "payment")
STATE_CHANGING = ("POST", "PUT", "PATCH", "DELETE")


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


# Assets


def ordered_assets(assets: DataFrame) -> DataFrame:
    """repo, place, id of all assets, the most critical first."""
    w = Window.partitionBy("repo").orderBy(rank_of(F.col("criticality"), CRITICALITY), "kind", "id")
    return assets.select("repo", F.row_number().over(w).alias("place"), "id")


def asset_matches(scan: Scan) -> DataFrame:
    """repo, kind, file, evidence: what speaks for each asset kind."""
    c = F.col
    place = location(c("file"), c("line"))
    path = lambda x: F.lower(F.replace(x, F.lit("\\"), F.lit("/")))

    def part(df: DataFrame, value: Column, evidence: Column, k: int) -> DataFrame:
        kinds = F.array_compact(F.array(*(F.when(has_any(value, rule[k]), rule[0]) for rule in ASSETS if rule[k])))
        return df.where(~low_quality_ext(c("file"))).select("repo", F.explode(kinds).alias("kind"), "file", evidence.alias("evidence"))

    files = scan.route.select("repo", "file").union(scan.secret_hint.select("repo", "file")).union(family(scan, "framework", "service", "auth").select("repo", "file")).distinct()
    return union(
        [part(scan.secret_hint, F.lower("name"), text("secret:", c("name"), " (", place, ")"), 3), part(scan.route, path(c("path")), text("route:", c("method"), " ", c("path"), " (", place, ")"), 4), part(files, path(c("file")), text("file:", c("file")), 5)]
    )


def rule_assets(scan: Scan) -> DataFrame:
    """repo, id, kind, name, criticality, locations, evidence (the first twelve): one asset for each kind found."""
    matched = settled(asset_matches(scan).distinct(), "asset_matches")  # read twice; the words are looked for once
    keys = ["repo", "kind"]
    found = matched.groupBy(*keys).agg(sorted_set("file").alias("locations")).join(first_values(matched, keys, F.col("evidence"), 12, "evidence"), keys)
    name, criticality = (F.create_map(*(F.lit(x) for r in ASSETS for x in (r[0], r[i])))[F.col("kind")] for i in (1, 2))
    return found.select("repo", text("asset:", F.col("kind")).alias("id"), "kind", name.alias("name"), criticality.alias("criticality"), "locations", "evidence")


def secret_assets(scan: Scan) -> DataFrame:
    """The same columns: one asset for each secret name that says what it is; the first occurrence counts."""
    low = F.lower("name")
    which = F.lit(None).cast("int")
    for i, (pattern, *_) in reversed(list(enumerate(SECRET_ASSETS))):
        which = F.when(low.rlike(pattern), i).otherwise(which)
    rows = scan.secret_hint.where(~low_quality_ext(F.col("file"))).withColumns({"i": which, "low": low}).where("i is not null")
    one = rows.groupBy("repo", "low").agg(F.min_by(F.struct("i", "name", "file", "line"), "seq").alias("r")).select("repo", "low", "r.*")
    kind, name, criticality = (F.array(*(F.lit(r[k]) for r in SECRET_ASSETS))[F.col("i")] for k in (1, 2, 3))
    return one.select(
        "repo",
        text("asset:secret:", F.col("low")).alias("id"),
        kind.alias("kind"),
        text(name, ": ", F.col("name")).alias("name"),
        criticality.alias("criticality"),
        F.array("file").alias("locations"),
        F.array(text("secret:", F.col("name"), " (", location(F.col("file"), F.col("line")), ")")).alias("evidence"),
    )


def detect_assets(scan: Scan) -> DataFrame:
    """All assets, with one for the business data where a repository has a database but nothing more sensitive."""
    found = settled(rule_assets(scan).unionByName(secret_assets(scan)), "found_assets")
    db = scan.database_hint.where(~low_quality_ext(F.col("file"))).join(found.where(F.col("kind").isin(*SENSITIVE)).select("repo").distinct(), "repo", "left_anti")
    kinds = db.groupBy("repo").agg(F.transform(sorted_set("kind"), lambda k: F.concat(F.lit("datastore:"), k)).alias("evidence"))  # a few kinds
    rest = kinds.join(first_values(db, ["repo"], F.col("file"), 8, "locations"), "repo")
    return found.unionByName(
        rest.select("repo", F.lit("asset:business_data").alias("id"), F.lit("business_data").alias("kind"), F.lit("Business / operational data store").alias("name"), F.lit("medium").alias("criticality"), "locations", "evidence")
    )


CRITICALITY = ("critical", "high", "medium", "low")
STRENGTHS = ("strong", "moderate", "weak", "absent")


def sensitive(kinds: tuple[str, ...] = SENSITIVE) -> Column:
    return F.col("criticality").isin("critical", "high") | F.col("kind").isin(*kinds)


# Controls


def signal_text(scan: Scan) -> DataFrame:
    """repo, label, file, line that control patterns are looked for in: hints of all families, and route paths."""
    return scan.hint.where(F.col("family").isin(*FAMILIES)).select("repo", F.col("hint").alias("label"), "file", "line").unionByName(scan.route.select("repo", F.col("path").alias("label"), "file", "line"))


def present_controls(scan: Scan) -> DataFrame:
    """repo, id, kind, name, strength, scope, placements (the first twelve), evidence (the first eight)."""
    which = F.array_compact(F.array(*(F.when(F.col("label").rlike("(?i)" + p), i) for i, (*_, p) in enumerate(CONTROLS))))
    place = text(F.col("label"), " (", location(F.col("file"), F.col("line")), ")")
    said = signal_text(scan).distinct()  # the patterns are tried once on what is said many times
    rows = settled(said.select("repo", "file", place.alias("e"), F.explode(which).alias("i")).distinct(), "said_controls")  # read three times
    keys = ["repo", "i"]
    found = rows.groupBy(*keys).agg(F.count_distinct("file").alias("n"))
    found = found.join(first_values(rows, keys, F.col("file"), 12, "p"), keys).join(first_values(rows, keys, F.col("e"), 8, "e"), keys)
    kind, name, strength = (F.array(*(F.lit(r[k]) for r in CONTROLS))[F.col("i")] for k in range(3))
    slug = F.replace(F.replace(F.lower(name), F.lit(" "), F.lit("_")), F.lit("/"), F.lit("_"))
    scope = F.when(F.col("n") >= 3, "global").when(F.col("n") > 1, "module").otherwise("route")
    return found.select(
        "repo",
        text("control:", kind, ":", slug).alias("id"),
        kind.alias("kind"),
        name.alias("name"),
        strength.alias("strength"),
        scope.alias("scope"),
        F.col("p").alias("placements"),
        F.col("e").alias("evidence"),
    )


ABSENT = (
    ("rate_limiting", "Rate limiting"),
    ("authentication", "Authentication enforcement"),
    ("csrf_protection", "CSRF protection"),
    ("audit_logging", "Audit logging"),
    ("encryption_at_rest", "Encryption at rest"),
    ("mfa", "Multi-factor authentication"),
)


#: Why a control is missed.
MISSED = {
    "rate_limiting": "There are public routes, but no sign of limits.",
    "authentication": "There are routes of authentication or administration, but no sign of a guard.",
    "csrf_protection": "Public routes change state, but nothing tells forged requests.",
    "audit_logging": "There are sensitive assets, but no sign of audit logs.",
    "encryption_at_rest": "There are sensitive assets, but no sign of encryption at rest.",
    "mfa": "There are routes of authentication or administration, but no sign of a second factor.",
}


def absent_controls(surfaces: DataFrame, assets: DataFrame, present: DataFrame) -> DataFrame:
    """repo, id, kind, name of the controls that surfaces and assets ask for and nothing shows."""
    public = F.col("exposure") == "public"
    s = surfaces.groupBy("repo").agg(F.bool_or(public).alias("public"), F.bool_or(F.col("category").isin("admin", "auth")).alias("guarded"), F.bool_or(public & F.upper("method").isin(*STATE_CHANGING)).alias("changing"))
    a = assets.groupBy("repo").agg(F.bool_or(sensitive()).alias("sensitive"))
    need = dict(zip((k for k, _ in ABSENT), ("public", "guarded", "changing", "sensitive", "sensitive", "guarded"), strict=True))
    rows = s.join(a, "repo", "full").na.fill(False)
    kinds = F.array_compact(F.array(*(F.when(F.col(f), F.struct(F.lit(k).alias("kind"), F.lit(n).alias("name"))) for (k, n), f in zip(ABSENT, need.values(), strict=True))))
    asked = rows.select("repo", F.inline(kinds))
    return asked.join(present.select("repo", "kind").distinct(), ["repo", "kind"], "left_anti").select("repo", text("control:absent:", F.col("kind")).alias("id"), "kind", "name")


def detect_controls(scan: Scan, surfaces: DataFrame, assets: DataFrame) -> DataFrame:
    present = settled(present_controls(scan), "present_controls")
    none = F.array().cast("array<string>")
    missing = absent_controls(surfaces, assets, present).select("repo", "id", "kind", "name", F.lit("absent").alias("strength"), F.lit("global").alias("scope"), none.alias("placements"), none.alias("evidence"))
    notes = F.create_map(*(F.lit(x) for kv in MISSED.items() for x in kv))[F.col("kind")]
    return present.withColumn("notes", F.lit(None).cast("string")).unionByName(missing.withColumn("notes", notes))
