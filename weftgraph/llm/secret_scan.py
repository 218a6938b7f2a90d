"""Secret scans with DataFrame functions only.

Base kinds are patterns (assignments to telling names, access keys, hex runs). The method adds ``random``: runs of 20 or more
identifier characters are read by two character Markov models, one trained from samples labelled random and one from samples
labelled ordinary (identifiers), and a run is a secret if the log-likelihood ratio of the two exceeds a threshold. Of any other
run, the segments of 20 or more whose ratio exceeds it are, so that paths and names around a secret do not hide it. What is inside a
base span is not reported again.

The labelled samples: random are the values of assignments and the keys and hex runs that the base patterns find in at most SAMPLE_TEXTS
texts of the table (those with the least hashed ids of four folds of five; the fifth is kept for measuring), and random
strings; ordinary are identifiers made of the other words of these texts, and of the fixed PARTS of program text.

Scanning is one narrow projection over whole texts: pattern functions give the matches and the pieces between them, whose
lengths add up to places. Running sums and maxima over matches are worked out by doubling, and pieces of a text are cut from chunks of it,
so a text with very many matches costs little more than its length. Cheap conditions that every match implies come first, so that most texts
are read twice and no more. The models are tables over 66 characters, counted by Spark; nothing else is collected.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fold_bucket, table

#: The kinds in order, their patterns, the part of a match that has a least length, and that length.
KINDS = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"(?<![0-9a-f])[0-9a-f]{24,}", 0, 24),
}
NAMES = ["password", "passwd", "secret", "token", "apikey", "api_key"]
CHARACTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
_RUN = "[A-Za-z0-9+/_-]"
#: A run of candidate characters; 20 is no more than any access key or hex run has.
LEAST = 20
CANDIDATE = f"(?<!{_RUN}){_RUN}{{{LEAST},}}"
#: What ordinary identifiers are made of, in the samples labelled ordinary.
PARTS = (
    "get set is has new old max min num total count index value name type list map item user order customer account address number "
    "date time start end first last next previous create update delete insert select table column row key field record request "
    "response handler manager service factory builder config option default system file path directory stream buffer reader writer "
    "parse format print error message event listener thread queue stack node tree graph edge vector matrix string integer boolean "
    "double float array object class method function variable parameter argument return result status state process network server "
    "client session connection database query transaction version release internal external public private static final abstract "
    "interface implementation collection iterator sequence element position length width height color image button window frame "
    "panel label content header footer section chapter paragraph sentence international organisation responsibility understanding "
    "communication development environment government information relationship straightforward unternehmen geschwindigkeit "
    "wissenschaft verantwortung gesellschaft developpement gouvernement environnement informacion comunicacion desarrollo"
).split()
#: Made strings of either label, texts that give samples at most, folds of which one is not learned from.
SAMPLES, SAMPLE_TEXTS, FOLDS, THRESHOLD, PSEUDO = 4000, 2000, 5, 12.0, 0.5
#: Code points of a chunk that pieces of a text are cut from.
CHUNK = 4096


def _named(value: Column, then) -> Column:
    """``then`` of ``value``, which is worked out once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _running(values: Column, add) -> Column:
    """The running totals of an array of int under ``add``, which must not mind nulls: after step k each holds those of the 2**(k+1) values up
    to it, so n values take n log n."""
    last = F.greatest(F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)).cast("double"))).cast("int") - 1, F.lit(0))

    def step(v, k):
        by = F.least(F.pow(F.lit(2.0), k).cast("int"), F.size(v))
        return F.zip_with(v, F.concat(F.array_repeat(F.lit(None).cast("int"), by), F.slice(v, F.lit(1), F.size(v) - by)), add)

    return F.aggregate(F.sequence(F.lit(0), last), values, step)


def _sums(values: Column) -> Column:
    return _running(values, lambda a, b: a + F.coalesce(b, F.lit(0)))


def _maxima(values: Column) -> Column:
    return _running(values, lambda a, b: F.greatest(a, b))


def samples_of(docs: DataFrame, learn: bool = True, texts: int = SAMPLE_TEXTS) -> DataFrame:
    """(sample, random) from at most ``texts`` texts of the folds that are learned from, or of the other: what the base patterns find, without
    the names before it, and the identifiers that the other words make."""
    kept = (fold_bucket(F.col("doc_id"), FOLDS) != 0) if learn else (fold_bucket(F.col("doc_id"), FOLDS) == 0)
    # the number that the chosen hashes end at is all that is collected; no text is shuffled
    place = F.xxhash64(F.col("doc_id").cast("long"))
    last = docs.where(kept).select(place.alias("place")).distinct().orderBy("place").limit(texts).agg(F.max("place")).first()[0]
    of = docs.select("doc_id", "text").where(F.col("text").isNotNull() & kept & (place <= F.lit(last).cast("long")))
    values, rest = [], F.col("text")
    for pattern, group, least in KINDS.values():
        values.append(F.filter(F.regexp_extract_all("text", F.lit(pattern), F.lit(group)), lambda v: F.length(v) >= least))  # noqa: B023
        rest = F.regexp_replace(rest, pattern, " ")
    words = F.regexp_extract_all(rest, F.lit(r"(?<![A-Za-z0-9])[A-Za-z]{2,19}(?![A-Za-z0-9])"), F.lit(0))
    both = of.select(F.concat(*values).alias("values"), words.alias("words"))
    starts = F.when(F.size("words") > 0, F.sequence(F.lit(1), F.size("words"), F.lit(3))).otherwise(F.expr("cast(array() as array<int>)"))
    labelled = lambda v, random: F.transform(v, lambda x: F.struct(x.alias("sample"), F.lit(random).alias("random")))
    named = F.transform(starts, lambda i: _joined(F.slice(F.col("words"), i, i % 4 + 2), i % 6))
    return both.select(F.explode(F.concat(labelled(F.col("values"), True), labelled(named, False))).alias("s")).select("s.*")


def _joined(words: Column, form: Column) -> Column:
    """An identifier of some words, in one of six forms."""
    return (
        F.when(form == 0, F.array_join(words, "_")).when(form == 1, F.array_join(words, "-")).when(form == 2, F.array_join(words, "/")).when(form == 3, F.upper(F.array_join(words, "_")))
        .when(form == 4, F.array_join(F.transform(words, F.initcap), "")).otherwise(F.array_join(words, ""))
    )


def labelled_samples(docs: DataFrame, n: int = SAMPLES) -> DataFrame:
    """(sample, random): those of ``docs`` and ``n`` made strings of either label, the same at every call."""
    return made_samples(docs.sparkSession, n).unionByName(samples_of(docs))


def made_samples(spark: SparkSession, n: int = SAMPLES) -> DataFrame:
    """(sample, random): n strings of either label, the same at every call."""
    ids = spark.range(n)
    digest = F.sha2(F.concat(F.lit("secret-"), F.col("id").cast("string")).cast("binary"), 256)
    letters = F.regexp_replace(F.base64(F.unhex(F.concat(digest, F.sha2(digest.cast("binary"), 256)))), "=", "")
    made = F.when(F.col("id") % 4 == 0, digest).when(F.col("id") % 4 == 1, F.upper(F.regexp_replace(letters, "[+/]", ""))).otherwise(letters)
    parts = F.array(*(F.element_at(F.lit(PARTS), (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(PARTS))) + 1).cast("int")) for k in range(5)))
    few = F.slice(parts, 1, (F.col("id") % 4 + 2).cast("int"))
    number = F.when(F.col("id") % 5 == 0, (F.pmod(F.xxhash64("id"), F.lit(100))).cast("string")).otherwise("")
    named = _joined(few, F.col("id") % 6)
    return ids.select(made.alias("sample"), F.lit(True).alias("random")).unionByName(ids.select(F.concat(named, number).alias("sample"), F.lit(False).alias("random")))


def ratios(samples: DataFrame) -> list[float]:
    """log (chance of the second character after the first in random strings / in ordinary ones), row by row over CHARACTERS.
    Characters that CHARACTERS lacks are skipped. Each label needs a sample; the result's size is that of the alphabet squared."""
    pairs = samples.where("sample is not null").select("random", F.explode(F.expr("transform(filter(sequence(1, length(sample)), i -> i < length(sample)), i -> substr(sample, i, 2))")).alias("pair"))
    n = len(CHARACTERS)
    place = {c: i for i, c in enumerate(CHARACTERS)}
    known = pairs.where(F.col("pair").rlike(f"^{_RUN}{{2}}$")).groupBy("random", "pair").count().collect()
    counts = {True: [[PSEUDO] * n for _ in range(n)], False: [[PSEUDO] * n for _ in range(n)]}
    for r in known:
        counts[r["random"]][place[r["pair"][0]]][place[r["pair"][1]]] += r["count"]
    chance = {k: [[x / sum(row) for x in row] for row in rows] for k, rows in counts.items()}
    return [math.log(chance[True][i][j] / chance[False][i][j]) for i in range(n) for j in range(n)]


def _steps(run: Column, table_: list[float]) -> Column:
    """The log-likelihood ratio of each character of a run of CHARACTERS after the one before it."""
    by_code = [0] * 128
    for i, c in enumerate(CHARACTERS):
        by_code[ord(c)] = i
    codes = F.expr(f"cast(split('{','.join(map(str, by_code))}', ',') as array<int>)")
    values = F.expr(f"cast(split('{','.join(f'{x:.6f}' for x in table_)}', ',') as array<double>)")
    code = lambda c: F.element_at(codes, F.ascii(c) + 1)
    before, after = F.split(F.substring(run, 1, F.length(run) - 1), ""), F.split(F.substring(run, 2, F.length(run)), "")
    return F.zip_with(before, after, lambda a, b: F.element_at(values, code(a) * len(CHARACTERS) + code(b) + 1))


def _ratio(run: Column, table_: list[float]) -> Column:
    """The log-likelihood ratio of a run of CHARACTERS."""
    return F.aggregate(_steps(run, table_), F.lit(0.0), lambda s, x: s + x)


_PART = "array<struct<start: int, end: int>>"


def _segments(run: Column, table_: list[float], threshold: float) -> Column:
    """The secret parts (start, end) of a run: all of it if its ratio exceeds ``threshold``, else its best segments of LEAST or
    more characters that do, from one ``/``, ``-`` or ``_`` to the next, and joined where they overlap.

    ``sum`` is the best ratio of a segment that ends here: the last one made longer, or the last LEAST characters. A segment ends
    at its highest place, once ``sum`` has fallen from there by ``threshold``; the next begins behind it."""
    part = lambda a, b: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"))
    none, low, bar = F.expr("cast(array() as array<bigint>)"), F.lit(-1e9), F.lit(float(threshold))
    zero = {"i": F.lit(0), "whole": F.lit(0.0), "window": F.lit(0.0), "sum": low, "from": F.lit(0), "top": bar, "start": F.lit(0), "end": F.lit(0), "least": F.lit(0), "done": none}
    state = lambda values: F.struct(*(values[k].alias(k) for k in zero))
    with_last = lambda s: F.when(s["top"] > bar, F.concat(s["done"], F.array(F.shiftleft(s["start"].cast("long"), 32) + s["end"]))).otherwise(s["done"])

    def step(s, x):
        begin, window, more = s["i"] - (LEAST - 2), s["window"] + x["new"] - x["old"], s["sum"] + x["new"]
        again = (begin >= s["least"]) & ((s["top"] <= bar) | (begin < s["end"])) & (window >= more)

        # no array through a lambda's result, which is copied: the state holds the segments done so far
        sum_, from_ = F.when(again, window).otherwise(more), F.when(again, begin).otherwise(s["from"])
        over, higher = (s["top"] > bar) & (sum_ <= s["top"] - bar), sum_ > s["top"]
        return state({
            "i": s["i"] + 1, "whole": s["whole"] + x["new"], "window": window, "sum": F.when(over, low).otherwise(sum_), "from": from_,
            "top": F.when(over, bar).otherwise(F.greatest(s["top"], sum_)), "start": F.when(higher, from_).otherwise(s["start"]),
            "end": F.when(higher, s["i"] + 2).otherwise(s["end"]), "least": F.when(over, s["end"]).otherwise(s["least"]), "done": F.when(over, with_last(s)).otherwise(s["done"]),
        })

    both = lambda v: F.zip_with(v, F.slice(F.concat(F.array_repeat(F.lit(0.0), LEAST - 1), v), F.lit(1), F.size(v)), lambda a, b: F.struct(a.alias("new"), b.alias("old")))
    whole = F.array(part(F.lit(0), F.length(run)))
    found = F.aggregate(_named(_steps(run, table_), both), state(zero), step, lambda s: F.when(s["whole"] > bar, whole).otherwise(F.transform(with_last(s), lambda d: part(F.shiftright(d, 32), d % (1 << 32)))))
    size = F.length(run)
    marked = lambda: F.transform(F.split(F.translate(run, "-_", "//"), ""), lambda c, i: F.when(c == "/", i))  # noqa: E731  # places of separators
    after_last = lambda: _maxima(_named(marked(), lambda m: F.transform(m, lambda i: F.coalesce(i + 1, F.lit(0)))))
    next_ = lambda: F.reverse(_running(_named(marked(), lambda m: F.reverse(F.transform(m, lambda i: F.coalesce(i, F.size(m))))), lambda a, b: F.least(a, b)))

    def widened(p):
        return _named(after_last(), lambda left: _named(next_(), lambda right: F.transform(p, lambda x: part(F.get(left, x["start"]), F.get(right, x["end"] - 1)))))

    def joined(p):
        """Pieces that overlap are one."""
        def over(reach):
            first = F.filter(F.sequence(F.lit(0), F.size(p) - 1), lambda i: (i == 0) | (F.get(p, i)["start"] >= F.get(reach, i - 1)))
            return _named(first, lambda f: F.transform(f, lambda i, at: part(F.get(p, i)["start"], F.get(reach, F.coalesce(F.get(f, at + 1), F.size(p)) - 1))))

        return F.when(F.size(p) > 1, _named(_maxima(F.transform(p, lambda x: x["end"])), over)).otherwise(p)

    return _named(found, lambda p: F.when((F.size(p) == 0) | (F.get(p, F.lit(0))["end"] - F.get(p, F.lit(0))["start"] == size), p).otherwise(_named(widened(p), joined)))


_SPAN = "array<struct<start: int, rank: int, end: int, kind: string>>"


def _placed(text: Column, pattern: str, kind: str, rank: int, good: Column) -> Column:
    """All matches of ``pattern`` as spans; ``good``: for each match, whether it stays."""

    def spans(found):
        sizes = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), found, lambda b, m: F.length(b) + F.length(m))
        ends = F.zip_with(_named(sizes, _sums), found, lambda end, m: F.struct((end - F.length(m)).alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind")))
        return F.filter(F.zip_with(ends, good, lambda s, g: F.when(g, s)), lambda s: s.isNotNull())

    return _named(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), spans).cast(_SPAN)


def with_spans(docs: DataFrame, name: str, table_: list[float], text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` and an array ``name`` of spans (start, rank, end, kind) in code points, end exclusive, by start and kind.

    Null and empty texts have none."""
    t, none = F.coalesce(F.col(f"`{text}`"), F.lit("")), F.expr(f"cast(array() as {_SPAN})")
    low = F.lower(t)
    telling = F.lit(False)
    for word in NAMES:
        telling = telling | F.contains(low, F.lit(word))
    conditions = {"assign": telling, "access": F.contains(t, F.lit("AKIA"))}
    flags, runs = f"{name}_named", f"{name}_runs"
    out = docs.withColumn(flags, conditions["assign"]).withColumn(runs, F.rlike(t, F.lit(CANDIDATE)))
    parts = []
    for rank, (kind, (pattern, group, least)) in enumerate(KINDS.items()):
        good = F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(group)), lambda m: F.length(m) >= least)  # noqa: B023
        when = F.col(flags) if kind == "assign" else F.col(runs) & conditions.get(kind, F.lit(True))
        parts.append(F.when(when, _placed(t, pattern, kind, rank, good)).otherwise(none))
    base, more = f"{name}_base", f"{name}_more"
    out = out.withColumn(base, F.array_sort(F.concat(*parts)))
    found = F.regexp_extract_all(t, F.lit(CANDIDATE), F.lit(0))
    placed = _placed(t, CANDIDATE, "random", len(KINDS), F.transform(found, lambda m: F.lit(True)))
    inside = lambda s, p: F.struct((s["start"] + p["start"]).alias("start"), s["rank"].alias("rank"), (s["start"] + p["end"]).alias("end"), s["kind"].alias("kind"))
    secret = F.flatten(F.zip_with(placed, found, lambda s, m: F.transform(_segments(m, table_, threshold), lambda p: inside(s, p))))
    out = out.withColumn(more, F.when(F.col(runs), secret).otherwise(none))

    def fresh(spans):
        """Without those of the method inside a base span, which begins before them or sorts first."""
        reach = _named(F.transform(spans, lambda s: F.when(s["rank"] < len(KINDS), s["end"]).otherwise(0)), _maxima)
        return F.filter(F.zip_with(spans, reach, lambda s, r: F.when((s["rank"] < len(KINDS)) | (r < s["end"]), s)), lambda s: s.isNotNull())

    every = F.when(F.size(more) > 0, _named(F.array_sort(F.concat(F.col(base), F.col(more))), fresh)).otherwise(F.col(base))
    return out.withColumn(name, every.cast(_SPAN)).drop(flags, runs, base, more)


def _told(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with every span (sorted by start; they may overlap) replaced by ``mark``."""

    def with_chunks(chunks):
        def cut(a, b):
            first, last = F.floor(a / CHUNK).cast("int"), F.floor(b / CHUNK).cast("int")
            head = F.substring(F.get(chunks, first), a % CHUNK + 1, b - a)
            middle, tail = F.array_join(F.slice(chunks, first + 2, F.greatest(last - first - 1, F.lit(0))), ""), F.substring(F.coalesce(F.get(chunks, last), F.lit("")), F.lit(1), b % CHUNK)
            return F.when(b <= a, F.lit("")).when(first == last, head).otherwise(F.concat(head, middle, tail))

        def with_reach(reach):
            before = lambda i: F.coalesce(F.get(reach, i - 1), F.lit(0))
            fresh = F.filter(F.sequence(F.lit(0), F.size(spans) - 1), lambda i: F.get(spans, i)["start"] >= before(i))
            done = F.transform(fresh, lambda i: F.concat(cut(before(i), F.get(spans, i)["start"]), F.lit(mark)))
            return F.concat(F.array_join(done, ""), cut(before(F.size(spans)), F.length(text)))

        return _named(_named(F.transform(spans, lambda s: s["end"]), _maxima), with_reach)

    return F.when(F.size(spans) > 0, _named(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)), with_chunks)).otherwise(text)


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex, base (text of the base spans), spans (of all).

    Null and empty texts have no span. A null doc_id stays null. Repeated rows give repeated rows; an empty table gives none. Of ``docs`` only doc_id and text are read."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = with_spans(slim, "found", ratios(labelled_samples(docs)))
    number = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(number, KINDS), _told(F.filter("found", lambda s: s["kind"] != "random")).alias("base"), _told(F.col("found")).alias("spans"))


def without_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with every span in text replaced by a mark; n_chars, if there is such a column, becomes the new length.

    Null and empty texts and those without a span stay as they are. Repeated rows stay rows of their own; an empty table stays empty.
    Other columns are kept, whatever their names."""
    name = "spans"
    while any(c.lower().startswith(name) for c in docs.columns):
        name += "_"
    found = with_spans(docs, name, ratios(labelled_samples(docs)))
    found = found.withColumn("text", redacted(F.col("text"), F.col(name)))
    if "n_chars" in docs.columns:
        # of the text as it is by now: a projection of its own, over the one that makes it
        changed = F.when(F.size(name) > 0, F.length("text")).otherwise(F.col("n_chars"))
        found = found.withColumn("n_chars", changed.cast(docs.schema["n_chars"].dataType))
    return found.select(*(F.col(f"`{c}`") for c in docs.columns))


def op10_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")
