"""Techniques of a public catalog for insights and findings, and what one could watch at run time to detect them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.expressions import first_rows, has_any, rank_of
from factloom.operators.chains import text
from factloom.operators.insights import filled, insight_order
from factloom.operators.threats import SEVERITIES, finding_order

# Id, name and tactic of the techniques, as the public catalog has them.
CATALOG = (
    ("T1190", "Exploit Public-Facing Application", "Initial Access"),
    ("T1078", "Valid Accounts", "Defense Evasion / Persistence / Initial Access"),
    ("T1199", "Trusted Relationship", "Initial Access"),
    ("T1212", "Exploitation for Credential Access", "Credential Access"),
    ("T1552", "Unsecured Credentials", "Credential Access"),
    ("T1110", "Brute Force", "Credential Access"),
    ("T1528", "Steal Application Access Token", "Credential Access"),
    ("T1068", "Exploitation for Privilege Escalation", "Privilege Escalation"),
    ("T1098", "Account Manipulation", "Persistence / Privilege Escalation"),
    ("T1562", "Impair Defenses", "Defense Evasion"),
    ("T1565", "Data Manipulation", "Impact"),
    ("T1485", "Data Destruction", "Impact"),
    ("T1041", "Exfiltration Over C2 Channel", "Exfiltration"),
    ("T1071", "Application Layer Protocol", "Command and Control"),
    ("T1059", "Command and Scripting Interpreter", "Execution"),
    ("T1556", "Modify Authentication Process", "Defense Evasion / Persistence"),
)
LINK = "https://attack.mitre.org/techniques/{id}/"
# Technique ids by insight kind and by words of a finding.
INSIGHT_TECHNIQUES = {
    "shared_secret_blast_radius": ("T1552", "T1528", "T1078"),
    "sensitive_asset_reachability": ("T1190", "T1041"),
    "control_bypass": ("T1562", "T1190"),
    "defense_gap_in_chain": ("T1190", "T1212"),
    "asymmetric_protection": ("T1190", "T1078"),
    "trust_boundary_violation": ("T1199", "T1190"),
    "audit_gap": ("T1562",),
    "control_strength_mismatch": ("T1110", "T1552"),
    "single_point_of_failure": ("T1552", "T1528", "T1556"),
    "admin_action_without_auth": ("T1078", "T1068", "T1098"),
}
FINDING_TECHNIQUES = (
    (("webhook", "callback"), ("T1190", "T1199")),
    (("admin", "manage", "privileged"), ("T1078", "T1068", "T1098")),
    (("upload",), ("T1190", "T1059")),
    (("auth", "login", "session"), ("T1078", "T1110", "T1556")),
    (("secret", "token", "key"), ("T1552", "T1528")),
    (("public route", "external"), ("T1190",)),
    (("exfil",), ("T1041",)),
    (("command", "rce", "exec"), ("T1059",)),
    (("data store", "datastore", "database"), ("T1565",)),
)
# Signal and title of the detection for each insight kind. Findings are matched by the words of the titles.
DETECTIONS = {
    "shared_secret_blast_radius": ("config_audit", "Detect signing-key drift across services"),
    "sensitive_asset_reachability": ("log", "Alert on unauthenticated access to sensitive-asset routes"),
    "control_bypass": ("trace", "Verify every request hits the global control middleware"),
    "defense_gap_in_chain": ("trace", "Add request-tracing to confirm controls actually run on this chain"),
    "asymmetric_protection": ("metric", "Compare per-method auth-rejection rates on the same route"),
    "trust_boundary_violation": ("network", "Network-level monitoring for cross-boundary traffic"),
    "audit_gap": ("log", "Establish baseline audit logs on sensitive-asset access"),
    "control_strength_mismatch": ("config_audit", "Add config-drift detection for missing controls on critical assets"),
    "single_point_of_failure": ("config_audit", "Track the blast-radius secret's last-rotated timestamp"),
    "stale_or_contradictory_signal": ("config_audit", "Annotate routes so static analysis stops contradicting itself"),
    "admin_action_without_auth": ("log", "Alert on any unauthenticated state change to admin/role routes"),
}
RESIDUAL = ("detect:findings:residual", "log", "Detection coverage for findings without a paired insight")
#: Of each kind: why to watch, and what; {routes} are the insight's first three, or the words given as the third item.
ADVICE = {
    "shared_secret_blast_radius": (
        "One key in many services should change everywhere at once; where it differs, an old or stolen one may be in use.",
        "Compare a hash of the secret between services each day. Alert if they differ, and on tokens signed by a key that is no longer current.",
    ),
    "sensitive_asset_reachability": (
        "A guard that code doesn't show can be looked for in traffic: no request without a session should succeed here.",
        "Alert on success status for routes ({routes}) where neither an authorization header nor a session cookie came along.",
        "the listed routes",
    ),
    "control_bypass": ("Watching that the control runs for each request finds a bypass without listing the routes.", "Give the control a span of its own, and alert on requests whose trace lacks it."),
    "defense_gap_in_chain": (
        "Code alone can't tell whether a control runs; traces between entry and sink can.",
        "Trace the entry handler and the data call. Alert if no span of authentication or rate limiting is above the data call's.",
    ),
    "asymmetric_protection": (
        "Whoever looks for the open method leaves many unauthenticated requests to it.",
        "For each route, alert when one method has ten times the unauthenticated requests of another.",
    ),
    "trust_boundary_violation": (
        "What should be internal is best watched at the border itself.",
        "At the edge, alert on requests for routes or hosts of the internal inventory, and on flows from the internet to internal workloads.",
    ),
    "audit_gap": (
        "Without records of access there is nothing to detect anything by.",
        "Record actor, action, asset and outcome at each access, collect the records, and alert on unusual hours, places or amounts.",
    ),
    "control_strength_mismatch": (
        "While code lacks the controls, the deployed settings can be watched.",
        "Each day, assert that policies, encryption at rest and log subscriptions are in place for the modules of these assets.",
    ),
    "single_point_of_failure": (
        "A key that everything rests on gets riskier with each day it isn't changed.",
        "Report the age of the secret, alert beyond the rotation policy, and on tokens signed by an earlier version.",
    ),
    "stale_or_contradictory_signal": (
        "There is nothing to detect here; clearer marks make the next scan better.",
        "Keep a list of routes with their categories as the one source of truth, and test handlers against it.",
    ),
    "admin_action_without_auth": (
        "A change of rights without a known actor should never succeed, so the first one counts.",
        "Alert at once on successful POST, PUT, PATCH or DELETE for routes ({routes}) without an authenticated actor.",
        "admin routes",
    ),
}
RESIDUAL_ADVICE = ("No insight covers these findings, yet run-time records can.", "Log finding, route and status at the handlers concerned, and collect the records.")


def lookup(key: Column, table: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[key]


def catalog(spark: SparkSession) -> DataFrame:
    """technique, name, tactic, link: all techniques that rules may name, and two that none does."""
    rows = [(i, name, tactic, LINK.replace("{id}", i.replace(".", "/"))) for i, name, tactic in CATALOG]
    return spark.createDataFrame(rows, "technique string, name string, tactic string, link string")


def of_insight() -> Column:
    """Technique ids of an insight's kind, in order."""
    known = F.create_map(*(x for k, v in INSIGHT_TECHNIQUES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    return F.coalesce(known[F.col("kind")], F.array().cast("array<string>"))


def of_finding() -> Column:
    """Technique ids that the words of title and evidence call for, each once, in order."""
    said = F.lower(F.concat_ws(" ", "title", F.replace("evidence", F.lit(" | "), F.lit(" "))))
    nothing = F.array().cast("array<string>")
    groups = F.array(*(F.when(has_any(said, words), F.array(*map(F.lit, ids))).otherwise(nothing) for words, ids in FINDING_TECHNIQUES))
    return F.array_distinct(F.flatten(groups))


def annotated(df: DataFrame, found: Column) -> DataFrame:
    """df with techniques: those it has, or if it has none, those found."""
    if "techniques" not in df.columns:
        return df.withColumn("techniques", found)
    return df.withColumn("techniques", F.when(F.size(F.coalesce("techniques", F.array().cast("array<string>"))) > 0, F.col("techniques")).otherwise(found))


def insight_techniques(insights: DataFrame) -> DataFrame:
    return annotated(insights, of_insight())


def finding_techniques(findings: DataFrame) -> DataFrame:
    return annotated(findings, of_finding())


def technique_use(insights: DataFrame, findings: DataFrame) -> DataFrame:
    """repo, technique, n (insights and findings it stands with), name, tactic, link."""
    rows = insight_techniques(insights).select("repo", F.explode("techniques").alias("technique"))
    rows = rows.union(finding_techniques(findings).select("repo", F.explode("techniques")))
    known = F.broadcast(catalog(insights.sparkSession))  # sixteen rows
    return rows.groupBy("repo", "technique").agg(F.count("*").alias("n")).join(known, "technique").select("repo", "technique", "n", "name", "tactic", "link")


OPPORTUNITY = ("repo", "id", "signal", "title", "rationale", "rule", "insight", "techniques", "findings")


def first(values: Column, n: int, whole: bool) -> Column:
    """The first n values of a list, or all of them."""
    return values if whole else F.slice(values, 1, n)


def residual_detections(insights: DataFrame, findings: DataFrame, whole: bool = False) -> DataFrame:
    """One row, without an insight, for each repository that has no insights but findings with techniques: the titles of
    its first five findings and the first six techniques, or if whole, of all."""
    alone = findings.join(insights.select("repo").distinct(), "repo", "left_anti")
    place = F.struct(finding_order()[0].alias("r"), F.col("title"), F.col("rule").alias("o"), F.col("techniques"))
    found = finding_techniques(alone).groupBy("repo").agg(F.array_sort(F.collect_list(place)).alias("f"))  # at most eleven
    ids = first(F.array_distinct(F.flatten(F.transform("f", lambda x: x["techniques"]))), 6, whole)
    titles = first(F.transform("f", lambda x: x["title"]), 5, whole)
    own, signal, title = RESIDUAL
    why, what = RESIDUAL_ADVICE
    rows = found.select(
        "repo", F.lit(own).alias("id"), F.lit(signal).alias("signal"), F.lit(title).alias("title"), F.lit(why).alias("rationale"), F.lit(what).alias("rule"),
        F.lit(None).cast("string").alias("insight"), F.array_join(ids, ",").alias("techniques"), F.array_join(titles, " | ").alias("findings"),
    )
    return rows.where("techniques <> ''")


def detection_opportunities(insights: DataFrame, findings: DataFrame, whole: bool = False) -> DataFrame:
    """repo, id, signal, title, rationale, rule, insight, techniques, findings: for the first insight of each kind, with up to
    three titles of findings that share a word of more than four letters with the opportunity's title; then the residual.
    If whole, all such titles are given, all of the insight's routes in the rule, and all of the residual."""
    c = F.col
    if "routes" not in insights.columns:
        insights = insights.withColumn("routes", F.array().cast("array<string>"))
    leading = insight_techniques(first_rows(insights, ["repo", "kind"], insight_order()).drop("rn"))
    named = F.array_join(F.transform(first(c("routes"), 3, whole), lambda r: F.concat(F.lit("`"), r, F.lit("`"))), ", ")
    rule = F.lit(None).cast("string")
    for kind, (_, what, *default) in ADVICE.items():
        said = filled(what, {"routes": F.when(named != "", named).otherwise(default[0])}) if default else F.lit(what)
        rule = F.when(c("kind") == kind, said).otherwise(rule)
    one = leading.select(
        "repo", text("detect:", c("id")).alias("id"), lookup(c("kind"), {k: s for k, (s, _) in DETECTIONS.items()}).alias("signal"),
        lookup(c("kind"), {k: t for k, (_, t) in DETECTIONS.items()}).alias("title"), lookup(c("kind"), {k: a[0] for k, a in ADVICE.items()}).alias("rationale"),
        rule.alias("rule"), c("id").alias("insight"), F.array_join("techniques", ",").alias("techniques"),
    )
    order = F.struct(rank_of(c("severity"), SEVERITIES).alias("r"), c("title"))
    titles = findings.groupBy("repo").agg(F.array_sort(F.collect_set(order)).alias("titles"))  # at most eleven
    words = F.filter(F.split(F.lower("title"), r"\s+"), lambda w: F.length(w) > 4)
    linked = F.filter(F.transform("titles", lambda t: t["title"]), lambda t: F.exists("words", lambda w: F.lower(t).contains(w)))
    rows = one.withColumn("words", words).join(titles, "repo", "left")
    paired = rows.withColumn("findings", F.coalesce(F.array_join(first(linked, 3, whole), " | "), F.lit(""))).select(*OPPORTUNITY)
    return paired.unionByName(residual_detections(insights, findings, whole))
