"""Findings and attack paths: a few rows for each repository, made from its surfaces, secrets and surest chains."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.expressions import first_rows, in_order, low_quality, rank_of, top_text
from factloom.operators.chains import atproto_chains, framework_chains, service_chains, text, top_chain
from factloom.operators.signals import auth_filtered, family
from factloom.operators.surfaces import classified, expanded
from factloom.sources.adapters import Scan
from factloom.sources.staged import settled_together

# Titles, severities and confidences; titles are read by later steps, so their words count.
FINDINGS = {
    "webhook": ("Public webhook endpoint may trust attacker-controlled events", "high", "high"),
    "admin": ("Administrative routes appear reachable from the main application surface", "high", "high"),
    "upload": ("Upload or import routes expand attacker-controlled input handling", "high", "medium"),
    "auth_gap": ("Authentication routes were detected without strong nearby auth controls", "medium", "medium"),
    "integration": ("Public routes appear to influence outbound integrations without clear auth signals", "medium", "medium"),
    "secret_env": ("Secret-bearing environment variables are referenced in executable paths", "medium", "high"),
    "public_data": ("Public routes likely sit close to sensitive data operations", "medium", "medium"),
    "fallback": ("Heuristic scan found only a limited attack surface", "low", "low"),
}
CHAIN_FINDINGS = {
    "atproto": ("AT Protocol XRPC surface chains into a downstream trust boundary", ("database", "privileged downstream action")),
    "service": ("Inter-service trust chain reaches a sensitive downstream sink", ("database", "privileged downstream action")),
    "framework": ("Framework route-to-service chain reaches a sensitive sink", ("database", "privileged action")),
}
PATHS = {
    "atproto": "AT Protocol namespace trust-chain abuse",
    "service": "Distributed service trust-chain abuse",
    "framework": "Framework route-to-sink attack chain",
    "webhook": "External event spoofing into internal state change",
    "admin": "Administrative route abuse",
    "auth": "Authentication boundary bypass",
    "upload": "Untrusted file handling abuse",
    "public_data": "Public input into sensitive data path",
    "integration": "Outbound trust boundary abuse",
}
#: What a path of each kind leads to.
IMPACTS = {
    "atproto": "Requests of a protocol namespace act on services behind it.",
    "service": "Trust between services carries a request to a sensitive sink.",
    "framework": "A routed request reaches a sink through controllers and services.",
    "webhook": "Forged events change what the business relies on.",
    "admin": "Privileged actions are open to whoever gets there.",
    "auth": "Protected behavior is reached without the right to it.",
    "upload": "Malicious content runs or stays.",
    "public_data": "Application data loses its guarantees.",
    "integration": "Other systems are steered, or steer this one.",
}
SEVERITIES = ("high", "medium", "low")
MOST = 10


def evidence_of(surface: str = "") -> Column:
    c = lambda x: F.col(f"{surface}{x}")
    auth = F.when(F.size(c("auth_signals")) > 0, text("auth signals: ", F.array_join(c("auth_signals"), ", "))).otherwise("no auth signals observed")
    return F.concat_ws("; ", text(c("method"), " ", c("route"), " in ", c("file")), auth, F.when(c("data_store"), "data store reachable"), F.when(c("outbound"), "external integration reachable"))


def chains_of(scan: Scan) -> dict[str, DataFrame]:
    """The surest chain of each kind: a row for each repository at most, read by several rules, so written once."""
    makers = {"atproto": atproto_chains, "service": service_chains, "framework": framework_chains}
    return settled_together({k: top_chain(make(scan)) for k, make in makers.items()})


def percent(confidence: Column) -> Column:
    return text("confidence=", F.format_string("%.2f", confidence))


def generate_findings(scan: Scan, surfaces: DataFrame) -> DataFrame:
    """repo, rule, title, severity, confidence, evidence (the first ten, joined by " | ")."""
    runtime = surfaces.where(~low_quality(F.col("file")))
    c = F.col
    public = c("exposure") == "public"
    rules = F.array_compact(
        F.array(
            F.when((c("category") == "webhook") & public & c("method").isin("POST", "PUT", "PATCH", "DELETE", "ANY") & (c("data_store") | c("outbound")) & ~c("trusted"), "webhook"),
            *(F.when(c("category") == x, x if x != "auth" else "auth_gap") for x in ("admin", "upload", "auth")),
            F.when(public & c("outbound"), "integration"),
            F.when(public & c("data_store") & (c("category") != "health"), "public_data"),
        )
    )
    hit = runtime.withColumn("rule", F.explode(rules))
    # Two rules hold for a repository as a whole.
    guarded = runtime.where((c("category") == "auth") & c("guarded")).select("repo", F.lit("auth_gap").alias("rule"))
    signed = family(scan, "auth").where(c("hint").isin("jwt", "oauth", "bearer", "token")).select("repo", F.lit("integration").alias("rule"))
    hit = hit.join(guarded.union(signed).distinct(), ["repo", "rule"], "left_anti")
    few = expanded(first_rows(hit, ["repo", "rule"], ["seq"], MOST), scan).withColumn("_v", evidence_of())
    parts = [in_order(few, ["repo", "rule"], "evidence")]
    parts.append(top_text(scan.secret_hint.withColumn("rule", F.lit("secret_env")), ["repo", "rule"], ["seq"], text(c("name"), " in ", c("file")), MOST, "evidence"))
    plain = reduce(DataFrame.unionByName, parts)
    titled = [F.create_map(*(F.lit(x) for k, v in FINDINGS.items() for x in (k, v[i])))[c("rule")] for i in range(3)]
    plain = plain.select("repo", "rule", titled[0].alias("title"), titled[1].alias("severity"), titled[2].alias("confidence"), "evidence")
    chained = [
        top.select(
            "repo",
            F.lit(k).alias("rule"),
            F.lit(title).alias("title"),
            F.when(c("sink").isin(*high), "high").otherwise("medium").alias("severity"),
            F.when(c("confidence") >= 0.7, "high").otherwise("medium").alias("level"),
            F.array_join(F.concat(F.array(percent(c("confidence"))), F.slice("evidence", 1, 6)), " | ").alias("evidence"),
        ).withColumnRenamed("level", "confidence")
        for (k, (title, high)), top in zip(CHAIN_FINDINGS.items(), chains_of(scan).values(), strict=True)
    ]
    found = reduce(DataFrame.unionByName, [plain, *chained])
    title, severity, confidence = FINDINGS["fallback"]
    nothing = scan.repo.join(found.select("repo").distinct(), "repo", "left_anti").select("repo", F.lit("fallback").alias("rule"), F.lit(title).alias("title"), F.lit(severity).alias("severity"), F.lit(confidence).alias("confidence"), F.lit("No strong pattern was found.").alias("evidence"))
    return found.unionByName(nothing)


def finding_order() -> list[Column]:
    return [rank_of(F.col("severity"), SEVERITIES), F.col("title")]


def step(label: str, *parts: str | Column) -> Column:
    return text(f"{label}: ", *parts)


def generate_attack_paths(scan: Scan, surfaces: DataFrame) -> DataFrame:
    """repo, place, kind, name, steps (array): one chain path, else up to five basic ones over different surfaces."""
    c = F.col
    entry = step("Entry", "Attacker reaches ", c("method"), " ", c("path"), " in ", c("file"))
    proof = step("Evidence", percent(c("confidence")), "; ", F.array_join(F.slice("evidence", 1, 4), "; "))
    hop = F.when(c("next_service").isNotNull(), step("Propagation", "Service trust edge lets the request reach `", c("next_service"), "`"))
    env = F.when(c("env_risk").isNotNull(), step("Config risk", "Behavior depends on env-configured endpoint ", c("env_risk")))
    steps = {
        "atproto": F.array_compact(
            F.array(entry, step("Namespace", "Endpoint is exposed in AT Protocol namespace `", c("namespace"), "`"), step("Service entry", "XRPC request is handled by service `", c("entry_service"), "`"), hop, env, step("Sink", "Influence reaches ", c("sink"), " through protocol-driven service flow"), proof)
        ),
        "service": F.array_compact(
            F.array(entry, step("Service entry", "Request is handled by service `", c("entry_service"), "`"), hop, env, step("Sink", "Influence reaches ", c("sink"), " by an unauthorized downstream action"), proof)
        ),
        "framework": F.array(
            entry,
            step("Routing", "Framework routing maps the request to ", F.coalesce("controller", F.lit("framework controller mapping")), " (", F.coalesce("action", F.lit("application action")), ")"),
            step("Execution", "Controller path likely invokes ", F.coalesce("service", F.lit("framework service/factory"))),
            step("Sink", "Request influence reaches ", c("sink"), " and may change state"),
            proof,
        ),
    }
    parts, taken = [], None
    for k, top in chains_of(scan).items():
        rows = top if taken is None else top.join(taken, "repo", "left_anti")
        parts.append(rows.select("repo", F.lit(1).alias("place"), F.lit(k).alias("kind"), F.lit(PATHS[k]).alias("name"), steps[k].alias("steps")))
        taken = top.select("repo") if taken is None else taken.union(top.select("repo"))
    basic = surfaces.where(~low_quality(c("file"))).join(taken.distinct(), "repo", "left_anti")
    public = c("exposure") == "public"
    cases = {
        "webhook": c("category") == "webhook",
        "admin": c("category") == "admin",
        "auth": c("category") == "auth",
        "upload": c("category") == "upload",
        "public_data": public & c("data_store") & (c("category") != "health"),
        "integration": public & c("outbound"),
    }
    key = F.struct("file", "route", "method")
    first = basic.groupBy("repo").agg(*(F.min_by(F.when(w, key), F.when(w, c("seq"))).alias(k) for k, w in cases.items()))
    # The claims follow a fixed order, so each candidate is compared with the claims before it.
    w = c("webhook").isNotNull() & (c("public_data").isNotNull() | c("integration").isNotNull())
    live: dict[str, Column] = {"webhook": w}
    claims: list[tuple[Column, Column]] = [(w, c("webhook")), (w, c("public_data")), (w, c("integration"))]
    for k in ("admin", "auth", "upload", "public_data", "integration"):
        new = c(k).isNotNull()
        for on, other in claims:
            new = new & ~F.coalesce(on & (other == c(k)), F.lit(False))
        live[k] = new
        claims.append((new, c(k)))
    at = lambda k: (c(f"{k}.method"), " ", c(f"{k}.route"), " in ", c(f"{k}.file"))
    basic_steps = {
        "webhook": F.array_compact(
            F.array(step("Entry", "An attacker reaches ", *at("webhook"), ", which takes untrusted events"), step("Weak point", F.lit("The event is trusted before it is verified")), F.when(c("public_data").isNotNull(), step("Propagation", F.lit("Attacker input is processed close to a data store"))), F.when(c("integration").isNotNull(), step("Propagation", F.lit("The request can also steer outbound service calls"))), step("Impact", F.lit("Business actions run without a trusted event")))
        ),
        "admin": F.array(
            step("Entry", "An attacker reaches ", *at("admin"), ", a privileged route"),
            step("Weak point", F.lit("Authorization is bypassed or enforced too late")),
            step("Propagation", F.lit("Administrative actions run with attacker influence")),
            step("Impact", F.lit("Privileged changes follow from one foothold")),
        ),
        "auth": F.array(
            step("Entry", "An attacker targets ", *at("auth"), ", which controls login, tokens, or session state"),
            step("Weak point", F.lit("Credentials or tokens are checked weakly")),
            step("Propagation", F.lit("The weakness becomes an authenticated foothold")),
            step("Impact", F.lit("Protected behavior can be reached")),
        ),
        "upload": F.array(
            step("Entry", "An attacker submits content to ", *at("upload")),
            step("Weak point", F.lit("Files are accepted or parsed too broadly")),
            step("Propagation", F.lit("Parsers or storage trust the content")),
            step("Impact", F.lit("Malicious content runs or persists")),
        ),
        "public_data": F.array(
            step("Entry", "An attacker uses ", *at("public_data"), " as a public foothold"),
            step("Weak point", F.lit("Validation is weaker than the exposure asks")),
            step("Propagation", F.lit("Attacker data reaches code close to the data store")),
            step("Impact", F.lit("Guarantees about application data weaken")),
        ),
        "integration": F.array(
            step("Entry", "An attacker influences ", *at("integration"), ", near an outbound integration"),
            step("Weak point", F.lit("External answers are trusted too far")),
            step("Propagation", F.lit("Steered third-party calls affect internal logic")),
            step("Impact", F.lit("Unsafe decisions follow from a weak external boundary")),
        ),
    }
    rows = F.array_compact(F.array(*(F.when(live[k], F.struct(F.lit(k).alias("kind"), F.lit(PATHS[k]).alias("name"), basic_steps[k].alias("steps"))) for k in cases)))
    simple = first.select("repo", F.posexplode(F.slice(rows, 1, 5)).alias("p", "x")).select("repo", (c("p") + 1).alias("place"), "x.kind", "x.name", "x.steps")
    return reduce(DataFrame.unionByName, [*parts, simple])


def translated(scan: Scan) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Surfaces and findings over auth-filtered hints; paths over the scan as it is."""
    clean = auth_filtered(scan)
    surfaces = classified(clean)
    return surfaces, generate_findings(clean, surfaces), generate_attack_paths(scan, classified(scan))
