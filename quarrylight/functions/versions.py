"""Versions as columns that sort by precedence, and range events folded over them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The published patterns of semantic versions, whole and short, and what their parts become.
FULL = r"^(0|[1-9]\d*)\.(0|[1-9]\d*)\.(0|[1-9]\d*)(?:-((?:0|[1-9]\d*|\d*[a-zA-Z-][0-9a-zA-Z-]*)(?:\.(?:0|[1-9]\d*|\d*[a-zA-Z-][0-9a-zA-Z-]*))*))?(?:\+[0-9a-zA-Z-]+(?:\.[0-9a-zA-Z-]+)*)?$"
LOOSE = r"^(0|[1-9]\d*)(?:\.(0|[1-9]\d*))?$"
KEY = "struct<major:bigint,minor:bigint,patch:bigint,released:int,pre:array<struct<alpha:int,number:bigint,name:string>>>"


def semver_key(version: Column) -> Column:
    """A struct that compares as semantic versions do; null if the text is no version.

    A release stands above its pre-releases; numeric identifiers stand below
    alphabetic ones; a pre-release that another begins with stands below it.
    """
    v = F.trim(F.regexp_replace(F.trim(version), r"^[v=]+", ""))
    part = lambda i: F.try_to_number(F.regexp_extract(v, FULL, i), F.lit("9" * 18))
    pre = F.regexp_extract(v, FULL, 4)
    names = F.transform(
        F.split(pre, r"\."),
        lambda p: F.struct(
            F.when(p.rlike(r"^\d+$"), 0).otherwise(1).alias("alpha"),
            F.when(p.rlike(r"^\d+$"), p.try_cast("bigint")).otherwise(F.lit(0)).cast("bigint").alias("number"),
            F.when(p.rlike(r"^\d+$"), F.lit("")).otherwise(p).alias("name"),
        ),
    )
    none = F.array().cast("array<struct<alpha:int,number:bigint,name:string>>")
    whole = F.struct(
        part(1).cast("bigint").alias("major"), part(2).cast("bigint").alias("minor"), part(3).cast("bigint").alias("patch"),
        F.when(pre == "", 1).otherwise(0).alias("released"), F.when(pre == "", none).otherwise(names).alias("pre"),
    )
    loose = lambda i: F.coalesce(F.regexp_extract(v, LOOSE, i).try_cast("bigint"), F.lit(0).cast("bigint"))
    short = F.struct(loose(1).alias("major"), loose(2).alias("minor"), F.lit(0).cast("bigint").alias("patch"), F.lit(1).alias("released"), none.alias("pre"))
    return F.when(v.rlike(FULL), whole.cast(KEY)).when(v.rlike(LOOSE), short.cast(KEY))


def in_events(version: Column, events: Column, kind_of_key: str = KEY) -> Column:
    """Whether a version key lies in a list of range events, folded in order.

    ``events``: array of (kind, key), kind being introduced, fixed, last_affected or
    limit. A fix ends an interval; what is open after the last event counts too.
    ``kind_of_key`` is the type of the keys.
    """
    nothing = F.lit(None).cast(kind_of_key)
    start = F.struct(nothing.alias("lo"), nothing.alias("fix"), nothing.alias("last"), nothing.alias("lim"), F.lit(False).alias("hit"))

    def inside(lo: Column, fix: Column, last: Column, lim: Column) -> Column:
        return (lo.isNull() | (version >= lo)) & (fix.isNull() | (version < fix)) & (last.isNull() | (version <= last)) & (lim.isNull() | (version < lim))

    def step(s: Column, e: Column) -> Column:
        kind, key = e["kind"], e["key"]
        ended = kind == "fixed"
        return F.struct(
            F.when(kind == "introduced", key).when(ended, nothing).otherwise(s["lo"]).alias("lo"),
            nothing.alias("fix"),
            F.when(kind == "last_affected", key).otherwise(s["last"]).alias("last"),
            F.when(kind == "limit", key).otherwise(s["lim"]).alias("lim"),
            (s["hit"] | (ended & inside(s["lo"], key, s["last"], s["lim"]))).alias("hit"),
        )

    end = lambda s: s["hit"] | ((s["lo"].isNotNull() | s["last"].isNotNull()) & inside(s["lo"], nothing, s["last"], s["lim"]))
    return F.when(version.isNotNull(), F.aggregate(events, start, step, end))


def remediation(version: Column, fixes: Column) -> Column:
    """The least fix above the version, else the greatest. ``fixes``: array of (key, text)."""
    above = F.array_min(F.filter(fixes, lambda f: f["key"] > version))
    return F.coalesce(above, F.array_max(fixes))["text"]


def _range_comparators(token: Column) -> Column:
    """(op, key) pairs that one npm comparator stands for; none if its version cannot be read."""
    op = F.regexp_extract(token, r"^(>=|<=|>|<|=|\^|~)?", 1)
    key = semver_key(F.regexp_replace(token, r"^(>=|<=|>|<|=|\^|~)", ""))
    none = F.array().cast("array<struct<alpha:int,number:bigint,name:string>>")
    zero = F.lit(0).cast("bigint")

    def release(major: Column, minor: Column, patch: Column) -> Column:
        return F.struct(major.alias("major"), minor.alias("minor"), patch.alias("patch"), F.lit(1).alias("released"), none.alias("pre")).cast(KEY)

    pair = lambda name, k: F.struct(F.lit(name).alias("op"), k.alias("key"))
    breaking = (
        F.when(key["major"] > 0, release(key["major"] + 1, zero, zero))
        .when(key["minor"] > 0, release(zero, key["minor"] + 1, zero))
        .otherwise(release(zero, zero, key["patch"] + 1))
    )
    plain = F.struct(F.when(op == "", "=").otherwise(op).alias("op"), key.alias("key"))
    return (
        F.when(key.isNull(), F.array().cast(f"array<struct<op:string,key:{KEY}>>"))
        .when(op == "^", F.array(pair(">=", key), pair("<", breaking)))
        .when(op == "~", F.array(pair(">=", key), pair("<", release(key["major"], key["minor"] + 1, zero))))
        .otherwise(F.array(plain))
    )


def npm_branches(text: Column) -> Column:
    """An npm range as an array of alternatives, each (any, comparators). Parse it once per range, not per version."""

    def branch(raw: Column) -> Column:
        part = F.regexp_replace(F.trim(raw), r"(>=|<=|>|<|=|~|\^)\s+", "$1")
        hyphen = r"^(\S+)\s+-\s+(\S+)$"
        ends = [semver_key(F.regexp_extract(part, hyphen, i)) for i in (1, 2)]
        span = F.array(*[F.struct(F.lit(op).alias("op"), k.alias("key")) for op, k in zip((">=", "<="), ends, strict=True)])
        listed = F.flatten(F.transform(F.filter(F.split(part, r"\s+"), lambda t: t != ""), _range_comparators))
        is_span = part.rlike(hyphen)
        bad_span = is_span & (ends[0].isNull() | ends[1].isNull())
        found = F.when(bad_span, F.array().cast(f"array<struct<op:string,key:{KEY}>>")).when(is_span, span).otherwise(listed)
        return F.struct((part == "").alias("any"), is_span.alias("span"), found.alias("all"))

    return F.transform(F.split(F.trim(text), r"\|\|"), branch)


def npm_satisfies(version: Column, text: Column) -> Column:
    """Whether a version key lies in an npm range: alternatives, hyphens, carets, tildes and comparisons."""
    return npm_meets(version, text, npm_branches(text))


def npm_meets(version: Column, text: Column, branches: Column) -> Column:
    """The same with the range read before, by ``npm_branches``.

    A pre-release satisfies an alternative only if one of its comparators is a
    pre-release of the same three numbers; a hyphen range has no such gate.
    """
    numbers = lambda k: F.struct(k["major"], k["minor"], k["patch"])
    unreleased = version["released"] == 0

    def holds(c: Column) -> Column:
        k = c["key"]
        return F.when(c["op"] == "=", version == k).when(c["op"] == ">", version > k).when(c["op"] == ">=", version >= k).when(c["op"] == "<", version < k).otherwise(version <= k)

    def alternative(b: Column) -> Column:
        allowed = ~unreleased | b["span"] | F.exists(b["all"], lambda c: (c["key"]["released"] == 0) & (numbers(c["key"]) == numbers(version)))
        return b["any"] | ((F.size(b["all"]) > 0) & allowed & F.forall(b["all"], holds))

    every = F.trim(text).isin("", "*", "x", "X")
    return F.when(version.isNotNull() & text.isNotNull(), F.when(every, ~unreleased).otherwise(F.exists(branches, alternative)))


# Fixed value: the published form of Python package versions.
PEP440 = r"(?i)^\s*v?(?:(\d+)!)?(\d+(?:\.\d+)*)(?:[-_.]?(alpha|a|beta|b|preview|pre|c|rc)[-_.]?(\d*))?(?:(?:-(\d+))|(?:[-_.]?(post|rev|r)[-_.]?(\d*)))?(?:[-_.]?(dev)[-_.]?(\d*))?(?:\+([a-z0-9]+(?:[-_.][a-z0-9]+)*))?\s*$"


PEP440_KEY = "struct<epoch:bigint,release:array<bigint>,pre:int,pre_number:bigint,post:bigint,dev:bigint,local:array<struct<numeric:int,number:bigint,name:string>>>"


def pep440_key(version: Column) -> Column:
    """A struct that compares as Python package versions do; null if the text is no version.

    Trailing zeros of the release do not count. A development release stands below
    every pre-release of its release, those below the release, post-releases above.
    """
    part = lambda i: F.regexp_extract(version, PEP440, i)
    number = lambda c: F.coalesce(c.try_cast("bigint"), F.lit(0).cast("bigint"))
    kind, implicit, post, dev, local = F.lower(part(3)), part(5), part(6), part(8), F.lower(part(10))
    release = F.transform(F.split(F.regexp_replace(part(2), r"(\.0+)+$", ""), r"\."), number)
    has_post, has_dev = (implicit != "") | (post != ""), dev != ""
    rank = F.when(kind.isin("a", "alpha"), 1).when(kind.isin("b", "beta"), 2).when(kind != "", 3).when(has_dev & ~has_post, 0).otherwise(9)
    words = F.transform(
        F.split(local, r"[-_.]"),
        lambda w: F.struct(F.when(w.rlike(r"^\d+$"), 1).otherwise(0).alias("numeric"), number(w).alias("number"), F.when(w.rlike(r"^\d+$"), "").otherwise(w).alias("name")),
    )
    none = F.array().cast("array<struct<numeric:int,number:bigint,name:string>>")
    key = F.struct(
        number(part(1)).alias("epoch"), release.alias("release"), rank.alias("pre"), number(part(4)).alias("pre_number"),
        F.when(implicit != "", number(implicit)).when(post != "", number(part(7))).otherwise(F.lit(-1).cast("bigint")).alias("post"),
        F.when(has_dev, number(part(9))).otherwise(F.lit((1 << 63) - 1)).alias("dev"),
        F.when(local == "", none).otherwise(words).alias("local"),
    )
    return F.when(version.rlike(PEP440), key)


def pep440_specifiers(text: Column) -> Column:
    """A comma-separated list of specifiers, read once: array of (op, raw, star, key, numbers)."""

    def one(s: Column) -> Column:
        op, raw = F.regexp_extract(s, r"^(===|~=|==|!=|<=|>=|<|>)", 1), F.trim(F.regexp_replace(s, r"^(===|~=|==|!=|<=|>=|<|>)", ""))
        name = F.regexp_replace(raw, r"\.\*$", "")
        numbers = F.transform(F.split(F.regexp_extract(name, PEP440, 2), r"\."), lambda n: n.try_cast("bigint"))
        return F.struct(op.alias("op"), F.lower(raw).alias("raw"), raw.endswith(".*").alias("star"), pep440_key(name).alias("key"), numbers.alias("numbers"))

    return F.transform(F.filter(F.transform(F.split(text, ","), lambda s: F.trim(s)), lambda s: s != ""), one)


def pep440_satisfies(version: Column, specifiers: Column) -> Column:
    """Whether a version (text) meets a comma-separated list of specifiers; null if either cannot be read."""
    return pep440_meets(version, pep440_key(version), pep440_specifiers(specifiers))


def pep440_meets(version: Column, v: Column, specifiers: Column) -> Column:
    """The same with the version's key and the specifiers read before."""
    forever = F.lit((1 << 63) - 1)
    bare = lambda k: F.struct(k["epoch"], k["release"], k["pre"], k["pre_number"], k["post"], k["dev"])
    base = lambda k: F.struct(k["epoch"], k["release"])
    stem = lambda k: F.struct(k["epoch"], k["release"], k["pre"], k["pre_number"])
    early = lambda k: (k["pre"] < 9) | (k["dev"] != forever)

    def prefix(k: Column, numbers: Column) -> Column:
        """Same epoch and the same first numbers; a shorter release counts zeros."""
        have = F.transform(numbers, lambda n, i: F.coalesce(F.get(v["release"], i), F.lit(0).cast("bigint")) == n)
        return (v["epoch"] == k["epoch"]) & F.forall(have, lambda x: x)

    def one(s: Column) -> Column:
        op, k, numbers = s["op"], s["key"], s["numbers"]
        same = F.when(s["star"], prefix(k, numbers)).when(F.size(k["local"]) > 0, v == k).otherwise(bare(v) == bare(k))
        below = (bare(v) < bare(k)) & ~(~early(k) & early(v) & (base(v) == base(k)) & (k["post"] == F.when(v["pre"] < 9, -1).otherwise(v["post"])))
        above = (bare(v) > bare(k)) & ~((k["post"] < 0) & (k["dev"] == forever) & (v["post"] >= 0) & (stem(v) == stem(k)))
        return (
            F.when(op == "===", F.lower(F.trim(version)) == s["raw"]).when(op == "==", same).when(op == "!=", ~same)
            .when(op == "<=", bare(v) <= bare(k)).when(op == ">=", bare(v) >= bare(k)).when(op == "<", below).when(op == ">", above)
            .when(op == "~=", (bare(v) >= bare(k)) & prefix(k, F.slice(numbers, F.lit(1), F.size(numbers) - 1)))
        )

    return F.when(v.isNotNull(), F.forall(specifiers, one))


def _padded(number: Column) -> Column:
    """A number up to 19 digits as a text that sorts as it does; null is below all."""
    return F.coalesce(F.lpad(number.cast("string"), 19, "0"), F.lit(""))


def _identifiers(each: Column, low: str, numeric: int) -> Column:
    """Identifiers in order, each with a mark for its kind and an end below all letters, then an end below all marks."""
    one = lambda p: F.concat(F.when(p[low] == numeric, "\x03").otherwise("\x02"), F.when(p["name"] == "", _padded(p["number"])).otherwise(p["name"]), F.lit("\x01"))
    return F.concat(F.array_join(F.transform(each, one), ""), F.lit("\0"))


def semver_bytes(key: Column) -> Column:
    """A ``semver_key`` as a text whose order of bytes is the order of versions.

    Such a text can be kept in a table: a file's least and greatest then say which versions are in it, and joins
    and sorts compare bytes without reading a version again. Null stays null.
    """
    return F.when(key.isNotNull(), F.concat(_padded(key["major"]), _padded(key["minor"]), _padded(key["patch"]), key["released"].cast("string"), _identifiers(key["pre"], "alpha", 1)))


def pep440_bytes(key: Column) -> Column:
    """The same for a ``pep440_key``."""
    release = F.concat(F.array_join(F.transform(key["release"], lambda n: F.concat(F.lit("\x01"), _padded(n))), ""), F.lit("\0"))
    post = F.when(key["post"] < 0, "0").otherwise(F.concat(F.lit("1"), _padded(key["post"])))
    return F.when(key.isNotNull(), F.concat(_padded(key["epoch"]), release, key["pre"].cast("string"), _padded(key["pre_number"]), post, F.lit("\x01"), _padded(key["dev"]), _identifiers(key["local"], "numeric", 1)))
