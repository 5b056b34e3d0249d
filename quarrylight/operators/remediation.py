"""Patches as rows: which paths may be touched, what changes, who conflicts, and where a proposal stands."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrylight.operators import mending
from quarrylight.operators.relational import overlaps
from quarrylight.sources import python_code, script_code
from quarrylight.sources.shared import settled

# Paths that no patch may touch.
PROTECTED = (
    r"(^|/)\.env(\..+)?$",
    r"(^|/)\.git(/|$)",
    r"(^|/)\.ssh(/|$)",
    r"\.(pem|key|pkcs12|pfx|crt|cer)$",
    r"(^|/)(id_rsa|id_ecdsa|id_ed25519)(\..+)?$",
    r"(^|/)(credentials|secrets|token|master_key)(\.json|\.yaml|\.yml|\.txt)?$",
)

#: The states that may follow each state of a proposal; None stands before the first.
FOLLOWS: dict[str | None, tuple[str, ...]] = {
    None: ("PROPOSED",),
    "PROPOSED": ("VALIDATED", "VALIDATION_FAILED", "REJECTED", "STALE"),
    "VALIDATION_FAILED": ("VALIDATED", "REJECTED", "STALE"),
    "VALIDATED": ("APPROVED", "REJECTED", "STALE"),
    "APPROVED": ("APPLIED", "REJECTED", "STALE", "FAILED"),
}


def protected(path: Column) -> Column:
    """Whether a path names keys, secrets or version control, leaves its folder or is a drive; true for empty ones."""
    plain = F.regexp_replace(F.trim(F.regexp_replace(path, r"\\", "/")), "^/+", "")
    found = plain.contains("..") | plain.contains(":") | (plain == "")
    for pattern in PROTECTED:
        found = found | plain.rlike(f"(?i){pattern}")
    return F.coalesce(found, F.lit(True))


def hmac_sha256(body: Column, secret: bytes) -> Column:
    """The keyed hash of a text or binary, in hex, from SHA-256 alone. The padded secret stands in the plan."""
    key = (hashlib.sha256(secret).digest() if len(secret) > 64 else secret).ljust(64, b"\0")
    pad = lambda x: F.lit(bytes(k ^ x for k in key))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), body.cast("binary")), 256))
    return F.sha2(F.concat(pad(0x5C), inner), 256)


def verified(body: Column, signature: Column, secret: bytes) -> Column:
    """Whether the signature, with or without ``sha256=``, is that of the body; false if there is none."""
    return F.coalesce(F.regexp_replace(signature, "^sha256=", "") == hmac_sha256(body, secret), F.lit(False))


def bound(body: Callable[..., Column], /, **values: Column) -> Column:
    """``body`` of values that are computed once each, however often it names them."""
    held = F.struct(*[v.alias(k) for k, v in values.items()])
    return F.element_at(F.transform(F.array(held), lambda x: body(**{k: x[k] for k in values})), 1)


def unified_diff(path: Column, before: Column, start: Column, end: Column, new: Column, around: int = 3) -> Column:
    """What replacing lines ``start`` to ``end`` (from 1) by ``new`` changes, as a unified diff; empty if nothing, null if they are not in the text.

    Equal lines at the span's ends are no change; what is between them goes and comes as a whole.
    """
    text = F.replace(before, F.lit("\r\n"), F.lit("\n"))
    cut = lambda text: F.split(F.when(text.endswith("\n"), F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text), "\n")
    body = F.split(F.regexp_replace(F.replace(new, F.lit("\r\n"), F.lit("\n")), "\n+\\z", ""), "\n")
    name = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "^/+", "")
    mark = lambda sign, part: F.transform(part, lambda x: F.concat(F.lit(sign), x, F.lit("\n")))

    def lead(lines: Column, a: Column, z: Column, body: Column, name: Column) -> Column:
        gone = F.slice(lines, a, z - a + 1)
        return bound(tail, lines=lines, a=a, z=z, body=body, name=name, gone=gone, lead=_equal_run(gone, body, F.least(F.size(gone), F.size(body))))

    def tail(lines: Column, a: Column, z: Column, body: Column, name: Column, gone: Column, lead: Column) -> Column:
        most = F.least(F.size(gone), F.size(body)) - lead
        return bound(rest, lines=lines, a=a, z=z, body=body, name=name, gone=gone, lead=lead, tail=_equal_run(F.reverse(gone), F.reverse(body), most))

    def rest(lines: Column, a: Column, z: Column, body: Column, name: Column, gone: Column, lead: Column, tail: Column) -> Column:
        """The lines that go are those from ``at`` to ``last``; last < at if none does."""
        at, last = a + lead, z - tail
        first = F.greatest(F.lit(1), at - around)
        old, fresh = F.slice(gone, lead + 1, F.size(gone) - lead - tail), F.slice(body, lead + 1, F.size(body) - lead - tail)
        behind = F.slice(lines, last + 1, F.least(F.lit(around), F.size(lines) - last))
        return bound(shown, name=name, first=first, ahead=F.slice(lines, first, at - first), old=old, fresh=fresh, behind=behind)

    def shown(name: Column, first: Column, ahead: Column, old: Column, fresh: Column, behind: Column) -> Column:
        # A last line without a newline is shown without one, as it stands.
        every = F.concat(mark(" ", ahead), mark("-", old), mark("+", fresh), mark(" ", behind))
        count = lambda part: F.size(ahead) + F.size(part) + F.size(behind)
        span = lambda n: F.when(n == 1, first.cast("string")).otherwise(F.concat(F.when(n == 0, first - 1).otherwise(first).cast("string"), F.lit(","), n.cast("string")))
        head = F.concat(F.lit("--- a/"), name, F.lit("\n+++ b/"), name, F.lit("\n@@ -"), bound(lambda n: span(n), n=count(old)), F.lit(" +"), bound(lambda n: span(n), n=count(fresh)), F.lit(" @@\n"))
        return F.when((F.size(old) == 0) & (F.size(fresh) == 0), F.lit("")).otherwise(F.concat(head, F.array_join(every, "")))

    def inside(lines: Column, a: Column, z: Column, body: Column, name: Column) -> Column:
        return F.when((a >= 1) & (z >= a) & (z <= F.size(lines)), lead(lines, a, z, body, name))

    return bound(lambda text, a, z, body, name: bound(inside, lines=cut(text), a=a, z=z, body=body, name=name), text=text, a=start, z=end, body=body, name=name)


def _equal_run(a: Column, b: Column, most: Column) -> Column:
    """How many of the first ``most`` elements are equal before one is not."""
    pairs = F.zip_with(F.slice(a, F.lit(1), most), F.slice(b, F.lit(1), most), lambda x, y: x == y)
    return F.coalesce(F.nullif(F.array_position(pairs, F.lit(False)), F.lit(0).cast("long")) - 1, F.size(pairs).cast("long")).cast("int")


def replaced_lines(text: Column, start: Column, end: Column, new: Column) -> Column:
    """The text with lines ``start`` to ``end`` (from 1) replaced; null if they are not in it. Its kind of newline stays."""
    newline = F.when(text.contains("\r\n"), "\r\n").otherwise("\n")
    lines = F.split(text, "\r?\n")
    inside = (start >= 1) & (end >= start) & (end <= F.size(lines))
    body = F.split(F.regexp_replace(new, "(\r?\n)+$", ""), "\r?\n")
    whole = F.concat(F.slice(lines, F.lit(1), start - 1), body, F.slice(lines, end + 1, F.size(lines) - end))
    return F.when(inside, F.replace(F.array_join(whole, "\n"), F.lit("\n"), newline))


def standing(log: DataFrame, key: str, state: str, order: list[str]) -> DataFrame:
    """key, state, steps, invalid: where each proposal stands after its log, and how many of its steps no rule allows."""
    at = W.partitionBy(key).orderBy(*order)
    allowed = [f"{before or ''}>{after}" for before, some in FOLLOWS.items() for after in some]
    step = F.concat(F.coalesce(F.lag(state).over(at), F.lit("")), F.lit(">"), F.col(state))
    steps = log.select(key, state, *order, step.isin(allowed).alias("__ok"))
    return steps.groupBy(key).agg(F.max_by(state, F.struct(*order)).alias("state"), F.count(F.lit(1)).alias("steps"), F.count_if(~F.col("__ok")).alias("invalid"))


def bundle(proposals: DataFrame, ready: tuple[str, ...] = ("VALIDATED", "APPROVED", "APPLIED"), lines: int = 200) -> DataFrame:
    """proposal_id, file_path, conflict, patch of the proposals that are ready and may touch their file.

    ``proposals``: proposal_id, file_path, start_line, end_line, state, rule_id, before,
    new. ``conflict`` is the smallest other ready proposal whose lines in the
    same file overlap, null without one; a bundle is whole only if none has any.
    Patches are rows, to be written in order of file and id, and are never gathered.
    """
    able = proposals.filter(F.col("state").isin(*ready) & ~protected(F.col("file_path")))
    pairs = overlaps(able, "file_path", "proposal_id", "start_line", "end_line", lines)
    both = pairs.select(F.col("a_id").alias("id"), F.col("b_id").alias("other")).unionByName(pairs.select(F.col("b_id").alias("id"), F.col("a_id").alias("other")))
    hits = both.groupBy("id").agg(F.min("other").alias("conflict"))
    head = F.concat(F.lit("# "), "file_path", F.lit(" ("), "rule_id", F.lit(")\n"))
    patch = F.concat(head, unified_diff(F.col("file_path"), F.col("before"), F.col("start_line"), F.col("end_line"), F.col("new")))
    return able.join(hits, F.col("proposal_id") == F.col("id"), "left").select("proposal_id", "file_path", "conflict", patch.alias("patch"))


def bundle_summary(made: DataFrame, proposals: DataFrame) -> DataFrame:
    """One row: the different files and rules of a bundle's proposals, in order, and how many conflict."""
    of = proposals.select(F.col("proposal_id").alias("__id"), "rule_id")
    joined = made.join(of, F.col("proposal_id") == F.col("__id"))
    return joined.agg(F.array_sort(F.collect_set("file_path")).alias("files"), F.array_sort(F.collect_set("rule_id")).alias("rules"), F.count_if(F.col("conflict").isNotNull()).alias("conflicts"))


def snippet(content: Column, start: Column, end: Column) -> Column:
    """Lines ``start`` to ``end`` of a text; null if the first is not in it."""
    lines = F.split(content, "\r?\n")
    return F.when((start >= 1) & (start <= F.size(lines)), F.array_join(F.slice(lines, start, F.least(end, F.size(lines)) - start + 1), "\n"))


def proposed(findings: DataFrame, sources: DataFrame, preferred: Column | None = None) -> DataFrame:
    """Every finding with the first strategy that can mend its lines: remediation_id, original, new, risk, sure; nulls where a person must.

    ``findings``: path, rule_id, line, end_line, ...; ``sources``: path, content.
    ``preferred``: a strategy's id to try alone, where it is not null. Changes are placed by the spans of the parsed calls, and what
    does not parse afterwards is not offered. Findings of vulnerable dependencies, with columns ``package`` and ``remediation``,
    get the raised line of their manifest, at that line.
    """
    of = sources.select(F.col("path").alias("__path"), F.col("content").alias("__content"))
    known = {"package", "remediation"} <= set(findings.columns)
    named = F.col("rule_id").isin(*mending.DEPENDENCY_RULES) if known else F.lit(False)
    joined = findings.filter(~F.coalesce(named, F.lit(False))).join(of, F.col("path") == F.col("__path"), "left")
    joined = joined.withColumn("original", snippet(F.col("__content"), F.col("line"), F.coalesce("end_line", "line")))
    asked = F.lit(None).cast("string") if preferred is None else preferred
    best = mending.proposed(joined.drop("__path"), "__content", asked)
    columns = [*findings.columns, "original", "remediation_id", "new", "risk", "sure"]
    if not known:
        return best.select(*columns)
    strategy, risk, sure = mending.UPGRADE
    raised = upgraded(findings.filter(named).select("path", "package", "remediation").distinct(), sources)
    raised = raised.select(F.col("path").alias("__p"), F.col("package").alias("__k"), F.col("line").alias("__line"), "original", "new")
    met = findings.filter(named & (asked.isNull() | (asked == strategy))).join(raised, (F.col("path") == F.col("__p")) & (F.col("package") == F.col("__k")), "left")
    fits = F.col("new").isNotNull()
    at = {c: F.coalesce(F.col("__line"), F.col(c)).cast(findings.schema[c].dataType) for c in ("line", "end_line")}
    upgrades = met.select(*[at.get(c, F.col(c)).alias(c) for c in findings.columns], "original", F.when(fits, strategy).alias("remediation_id"), "new", F.when(fits, risk).alias("risk"), F.when(fits, sure).alias("sure"))
    return best.select(*columns).unionByName(upgrades.select(*columns))


def upgraded(vulnerable: DataFrame, manifests: DataFrame) -> DataFrame:
    """path, package, line, original, new: the first line of a requirements or package.json file that declares a package, raised to its remedy.

    ``vulnerable``: path, package, remediation. A range keeps its caret or tilde, a requirement its comment.
    """
    lines = manifests.select(F.col("path").alias("__path"), F.posexplode(F.split("content", "\r?\n")).alias("__i", "original"))
    met = vulnerable.filter("remediation IS NOT NULL").join(lines, F.col("path") == F.col("__path"))
    name = F.concat(F.lit("\\Q"), "package", F.lit("\\E"))
    plain = F.concat(F.lit("(?i)^\\s*"), name, F.lit("\\s*([=><~^!].*?)?(\\s*#.*)?$"))
    keyed = F.concat(F.lit('(?i)^(\\s*"'), name, F.lit('"\\s*:\\s*")([^"]+)(".*)'))
    low, part = F.lower("path"), lambda pattern, i: F.call_function("regexp_extract", F.col("original"), pattern, F.lit(i))
    requirement = F.when(low.endswith("requirements.txt") & F.rlike("original", plain), F.concat("package", F.lit(">="), "remediation", part(plain, 2)))
    old = part(keyed, 2)
    sign = F.when(old.startswith("^"), "^").when(old.startswith("~"), "~").otherwise("")
    entry = F.when(low.endswith("package.json") & F.rlike("original", keyed), F.concat(part(keyed, 1), sign, "remediation", part(keyed, 3)))
    hits = met.withColumn("new", F.coalesce(requirement, entry)).filter("new IS NOT NULL")
    return hits.groupBy("path", "package").agg(F.min_by(F.struct((F.col("__i") + 1).alias("line"), "original", "new"), "__i").alias("x")).select("path", "package", "x.*")


# The checks of a patch, in order, and words that must be gone where no rule can look again.
PATCH_CHECKS = ("CHK-01-INTEGRITY", "CHK-02-STRUCTURE", "CHK-03-SYNTAX", "CHK-04-RULE-RECHECK", "CHK-05-REGRESSION-RISK")
FORBIDDEN = {"PYSEC001": ("eval(",), "PYSEC005": ("verify=False", "_create_unverified_context"), "JSSEC001": ("eval(",), "JSSEC002": (".innerHTML",)}
RECHECKED = ("PYSEC001", "PYSEC003", "PYSEC004", "PYSEC005")


def checked(proposals: DataFrame, sources: DataFrame) -> DataFrame:
    """proposal_id, valid, checks (array of check_id, state, told): what five checks say of each patch, up to the first that fails.

    ``proposals``: proposal_id, file_path, start_line, end_line, original, new,
    original_hash, target_hash, rule_id. ``sources``: path, content. A file must be the
    one that was read and no protected one; the lines must still be those, and give
    the text that was meant; the result must parse (Python by its parser, JSON by
    Spark, scripts by their brackets; other files are skipped); the rule must not
    hit the changed lines again; the last check only tells, as ``told``, what the patch may change,
    by the column ``remediation_id`` where there is one.
    """
    of = sources.select(F.col("path").alias("__path"), F.col("content").alias("__content"))
    joined = proposals.join(of, F.col("file_path") == F.col("__path"), "left")
    plain = lambda c: F.regexp_replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), r"\s+\z", "")
    same = plain(snippet(F.col("__content"), F.col("start_line"), F.col("end_line"))) == plain(F.col("original"))
    patched = F.when(same, replaced_lines(F.col("__content"), F.col("start_line"), F.col("end_line"), F.col("new")))
    made = settled(joined.select(*proposals.columns, "__content", patched.alias("__patched")), "patched")
    end = F.lower(F.regexp_extract("file_path", r"(\.[^./]+)\z", 1))
    named = made.filter(F.col("__patched").isNotNull()).select(F.col("proposal_id").cast("string").alias("path"), F.col("__patched").alias("content"), end.alias("end"))
    python = settled(python_code.facts(named.filter("end = '.py'")), "facts")
    script = script_code.facts(named.filter("end IN ('.js', '.jsx', '.ts', '.tsx')"))
    broken = python.select("path", "kind").unionByName(script.select("path", "kind")).filter("kind = 'syntax_error'").select(F.col("path").alias("__broken")).distinct()
    again = python_code.findings(python).select(F.col("path").alias("__again"), F.col("rule_id").alias("__rule"), F.col("line").alias("__line"))
    region = (F.col("proposal_id").cast("string") == F.col("__again")) & (F.col("rule_id") == F.col("__rule")) & F.col("__line").between(F.col("start_line") - 1, F.col("end_line") + 2)
    hit = made.filter(F.col("rule_id").isin(*RECHECKED)).join(again, region, "left_semi").select(F.col("proposal_id").alias("__hit")).distinct()
    known = made.join(broken, F.col("proposal_id").cast("string") == F.col("__broken"), "left").join(hit, F.col("proposal_id") == F.col("__hit"), "left")
    parsed = F.when(end.isin(".py", ".js", ".jsx", ".ts", ".tsx"), F.col("__broken").isNull()).when(end == ".json", F.try_parse_json("__patched").isNotNull()).when(F.lower("file_path").endswith("requirements.txt"), F.lit(True))
    lines = F.split("__patched", "\r?\n")
    near = F.array_join(F.slice(lines, F.greatest(F.lit(1), F.col("start_line")), F.col("end_line") - F.col("start_line") + 2), "\n")
    left = F.lit(False)
    for rule, words in FORBIDDEN.items():
        for w in words:
            left = left | ((F.col("rule_id") == rule) & F.contains(near, F.lit(w)))
    clean = F.when((end == ".py") & F.col("rule_id").isin(*RECHECKED), F.col("__hit").isNull()).otherwise(~left)
    told = lambda ok: F.when(F.coalesce(ok, F.lit(False)), "PASSED").otherwise("FAILED")
    states = [
        told(~protected(F.col("file_path")) & (F.sha2("__content", 256) == F.col("original_hash"))),
        told(F.sha2("__patched", 256) == F.col("target_hash")),
        F.when(parsed.isNull(), "SKIPPED").otherwise(told(parsed)),
        told(clean), F.lit("PASSED"),
    ]
    strategy = F.col("remediation_id") if "remediation_id" in proposals.columns else F.lit("")
    told_of = [*[F.lit(None).cast("string")] * 4, mending.risk_of(strategy)]
    every = F.array(*[F.struct(F.lit(c).alias("check_id"), s.alias("state"), t.alias("told")) for c, s, t in zip(PATCH_CHECKS, states, told_of, strict=True)])
    first = F.array_position(F.transform(every, lambda c: c["state"]), F.lit("FAILED"))
    return known.select("proposal_id", (first == 0).alias("valid"), F.when(first == 0, every).otherwise(F.slice(every, F.lit(1), first.cast("int"))).alias("checks"))
