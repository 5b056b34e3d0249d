"""Cutting documents into chunks: line windows, headings, byte-bounded parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.functions import files as fl
from quarrylight.functions.text import fingerprint
from quarrylight.operators.embedding import hash_vectors
from quarrylight.sources import python_code, script_code
from quarrylight.sources.shared import settled

WINDOW, OVERLAP, MOST_CHUNKS, MOST_BYTES = 50, 5, 500, 8192


def line_windows(docs: DataFrame, key: str, text: str, window: int = WINDOW, overlap: int = OVERLAP, most: int | None = MOST_CHUNKS) -> DataFrame:
    """key, chunk_index, start_line, end_line, content: windows of lines, ``most`` a document (None: all); blank ones are skipped."""
    lines = docs.select(key, F.split(text, "\n").alias("lines")).withColumn("n", F.size("lines"))
    step = window - overlap
    last = F.ceil(F.greatest(F.col("n") - window, F.lit(0)) / step).cast("int")
    start = lambda i: F.lit(1) + step * i
    content = lambda i: F.array_join(F.slice("lines", start(i), F.lit(window)), "\n")
    made = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(start(i).alias("start_line"), F.least(F.col("n"), start(i) + window - 1).alias("end_line"), content(i).alias("content")))
    # Windows are made inside the row: no row of a window carries all lines. Blank ones do not count.
    full = lines.select(key, F.filter(made, lambda w: w["content"].rlike(r"\S")).alias("cut"))
    cut = full.select(key, F.posexplode("cut" if most is None else F.slice("cut", 1, most)).alias("chunk_index", "w"))
    return cut.select(key, "chunk_index", "w.start_line", "w.end_line", "w.content")


def headings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, title, level, start_line, end_line: sections under Markdown headings of level 1 to 4."""
    lines = docs.select(key, F.split(text, "\n").alias("lines"))
    found = F.filter(F.transform("lines", lambda x, i: F.struct((i + 1).alias("line"), x.alias("x"))), lambda s: s["x"].rlike(r"^#{1,4}\s+.+$"))
    heads = lines.select(key, F.size("lines").alias("n"), found.alias("heads"))
    spans = F.transform("heads", lambda h, i: F.struct(h["line"].alias("start_line"), F.coalesce(F.try_element_at("heads", i + 2)["line"] - 1, F.col("n")).alias("end_line"), h["x"].alias("x")))
    out = heads.select(key, F.explode(spans).alias("s"))
    return out.select(key, F.regexp_extract("s.x", r"^#{1,4}\s+(.+)$", 1).alias("title"), F.length(F.regexp_extract("s.x", r"^(#{1,4})", 1)).alias("level"), "s.start_line", "s.end_line")


def byte_parts(docs: DataFrame, key: str, text: str, most: int = MOST_BYTES) -> DataFrame:
    """key, part, start_line, end_line: whole lines gathered until the next would pass ``most`` bytes.

    A fold over the lines with a running size that starts anew; a plain running
    sum cannot do that. A line longer than ``most`` is a part alone.
    """
    sizes = F.transform(F.split(text, "\n"), lambda x: F.octet_length(x) + 1)
    start = F.struct(F.lit(0).alias("size"), F.array().cast("array<int>").alias("starts"), F.lit(0).alias("line"))

    def step(s, n):
        fresh = (s["line"] == 0) | (s["size"] + n > most)
        return F.struct(
            F.when(fresh, n).otherwise(s["size"] + n).alias("size"),
            F.when(fresh, F.concat(s["starts"], F.array(s["line"] + 1))).otherwise(s["starts"]).alias("starts"),
            (s["line"] + 1).alias("line"),
        )

    folded = docs.select(key, F.aggregate(sizes, start, step).alias("f"))
    ends = F.transform("f.starts", lambda x, i: F.struct((i + 1).alias("part"), x.alias("start_line"), F.coalesce(F.try_element_at("f.starts", i + 2) - 1, F.col("f.line")).alias("end_line")))
    return folded.select(key, F.explode(ends).alias("p")).select(key, "p.*")


def symbol_chunks(facts: DataFrame) -> DataFrame:
    """path, kind, symbol, start_line, end_line: one span from the first to the last import, one for each class and each function.

    ``facts``: rows of a parser. Files with a syntax error give none.
    """
    broken = facts.filter("kind = 'syntax_error'").select("path").distinct()
    good = facts.join(broken, "path", "left_anti")
    imports = good.filter("kind = 'import'").groupBy("path").agg(F.min("line").alias("start_line"), F.max("end_line").alias("end_line")).select("path", F.lit("import").alias("kind"), F.lit(None).cast("string").alias("symbol"), "start_line", "end_line")
    return imports.unionByName(good.filter("kind IN ('class', 'function')").select("path", "kind", F.col("name").alias("symbol"), F.col("line").alias("start_line"), "end_line"))


def strategy(path: Column, language: Column) -> Column:
    """How a file is cut: python, script, sections or windows."""
    low, end = F.lower(F.coalesce(language, F.lit(""))), fl.ending(path)
    return (
        F.when((low == "python") | (end == ".py"), "python")
        .when(low.isin("javascript", "typescript", "jsx", "tsx") | end.isin(".js", ".jsx", ".ts", ".tsx"), "script")
        .when(end.isin(".md", ".rst", ".txt") | low.isin("markdown", "documentation", "text"), "sections")
        .otherwise("windows")
    )


def chunk_files(sources: DataFrame, most: int | None = MOST_CHUNKS, bytes_most: int = MOST_BYTES) -> DataFrame:
    """path, chunk_index, kind, symbol, part, start_line, end_line, content, content_hash of every (path, language, content) file.

    Python and scripts are cut at symbols, documentation at headings, all else, and
    files whose own way gives nothing, into line windows. Chunks of more than
    ``bytes_most`` bytes are cut further at lines (``part`` from 1), numbered in order
    of their lines, and ``most`` a file are kept (None: all). Blank files give none.
    """
    read = sources.filter(F.col("content").rlike(r"\S")).select("path", "content", strategy(F.col("path"), F.col("language")).alias("way"))
    code = read.filter("way = 'python'")
    script = read.filter("way = 'script'")
    own = symbol_chunks(python_code.facts(code)).unionByName(symbol_chunks(script_code.facts(script)))
    sections = headings(read.filter("way = 'sections'"), "path", "content").select("path", F.lit("section").alias("kind"), F.col("title").alias("symbol"), "start_line", "end_line")
    spans = own.unionByName(sections).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("start_line", "end_line", F.col("kind").alias("kind"), F.col("symbol").alias("symbol")))).alias("spans"))
    lines = F.split("content", "\n")
    joined = read.join(spans, "path", "left").select("path", lines.alias("lines"), "spans")
    text = lambda s: F.array_join(F.slice("lines", s["start_line"], s["end_line"] - s["start_line"] + 1), "\n")
    full = F.filter(F.coalesce("spans", F.array()), lambda s: text(s).rlike(r"\S"))
    total = F.size("lines")
    step = WINDOW - OVERLAP
    windows = F.transform(F.sequence(F.lit(0), F.ceil(F.greatest(total - WINDOW, F.lit(0)) / step).cast("int")), lambda i: F.struct((1 + step * i).alias("start_line"), F.least(total, 50 + step * i).alias("end_line"), F.lit("window").alias("kind"), F.lit(None).cast("string").alias("symbol")))
    chosen = F.when(F.size(full) > 0, full).otherwise(F.filter(windows, lambda s: text(s).rlike(r"\S")))
    cut = joined.select("path", "lines", chosen.alias("spans"))
    # Every span becomes one or more parts inside the row; only then do rows part, with their own lines alone.
    parts = F.flatten(F.transform("spans", lambda s: F.transform(_parts(F.slice("lines", s["start_line"], s["end_line"] - s["start_line"] + 1), bytes_most), lambda p: F.struct(
        s["kind"].alias("kind"), s["symbol"].alias("symbol"), p["part"].alias("part"), (s["start_line"] + p["from"] - 1).alias("start_line"), (s["start_line"] + p["to"] - 1).alias("end_line"),
        F.array_join(F.slice("lines", s["start_line"] + p["from"] - 1, p["to"] - p["from"] + 1), "\n").alias("content")))))
    each = cut.select("path", F.posexplode(parts if most is None else F.slice(parts, 1, most)).alias("chunk_index", "c"))
    return each.select("path", "chunk_index", "c.*", F.sha2("c.content", 256).alias("content_hash"))


def _parts(lines: Column, most: int) -> Column:
    """Spans (part, from, to) of an array of lines, each of ``most`` bytes at most or one line; part is null if one span is all."""
    sizes = F.transform(lines, lambda x: F.octet_length(x) + 1)
    start = F.struct(F.lit(0).alias("size"), F.array().cast("array<int>").alias("starts"), F.lit(0).alias("line"))

    def step(s, n):
        fresh = (s["line"] == 0) | (s["size"] + n > most)
        return F.struct(F.when(fresh, n).otherwise(s["size"] + n).alias("size"), F.when(fresh, F.concat(s["starts"], F.array(s["line"] + 1))).otherwise(s["starts"]).alias("starts"), (s["line"] + 1).alias("line"))

    whole = F.array(F.struct(F.lit(None).cast("int").alias("part"), F.lit(1).alias("from"), F.size(lines).alias("to")))
    spans = lambda f: F.transform(f["starts"], lambda x, i: F.struct((i + 1).alias("part"), x.alias("from"), F.coalesce(F.try_element_at(f["starts"], i + 2) - 1, f["line"]).alias("to")))
    return F.when(F.octet_length(F.array_join(lines, "\n")) <= most, whole).otherwise(spans(F.aggregate(sizes, start, step)))


def index_run(files: DataFrame, snapshot: str, dimension: int = 64, most: int | None = 500) -> DataFrame:
    """Chunks to search: those of files that are neither binary nor secret, with fingerprints and feature-hash vectors.

    ``files``: path, language, is_binary, content. ``most``: chunks of a file, None for all.
    """
    fit = files.filter(~F.coalesce("is_binary", F.lit(False)) & ~fl.secret(F.col("path")))
    chunks = settled(chunk_files(fit.select("path", "language", "content"), most=most), "chunks")
    print_ = fingerprint(F.lit(snapshot), F.col("path"), F.col("start_line"), F.col("end_line"), F.col("content_hash"))
    vectors = hash_vectors(chunks, ["path", "chunk_index"], "content", dimension)
    return chunks.withColumn("fingerprint", print_).join(vectors, ["path", "chunk_index"])
