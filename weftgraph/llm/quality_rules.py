"""Quality rules: plain limits first, then robust multivariate outliers.

Each text that passes the limits gives a vector of transformed statistics. For every language and source the minimum covariance
determinant (MCD; Rousseeuw and Van Driessen, 1999) estimates its centre and scatter: of the subsets that hold the share H of a group's rows, the
one whose scatter has the least determinant. From several starts (Hubert, Rousseeuw and Verdonck, 2012: coordinate-wise medians and
spreads, alone or with the correlations of spatial signs or of hyperbolic tangents) concentration steps take the mean and scatter of the
rows with the least distances, again and again; the best start is followed until the determinant falls no more. A step that does not lower it is
not taken. A text whose squared distance to its group's estimate exceeds a chi-squared quantile is rejected.

Groups of any size have an estimate of their own. As in the regularised MCD (Boudt et al., 2020) it is drawn to a target, that of its
language, with weight PRIOR / (rows + PRIOR): a group of few rows leans on its language, a large one on itself, and no size switches anything.

All rows count: a step is one aggregation by group and distance class (a few hundred rows a group), so a group of any size is summed
up before it is shuffled, and its estimate is made from those sums; of the class that the share H ends in, a part counts.
The statistics are rounded to a grid of 1/1024, so the sums are exact integers and reruns agree (up to about 10^11 rows a group).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from .shared import settle, table

#: Share of rows in the estimate, steps from each start, steps of the best one at most, the chi-squared quantile that is kept, rows that the target weighs.
H, TRIALS, STEPS, QUANTILE, PRIOR = 0.75, 2, 30, 1 - 1e-7, 30
#: The plain limits: words a text needs, and the percentage of its words in repeated windows that it may have.
MIN_WORDS, MAX_REPEATED = 50, 50
GRID = 1024
#: Groups whose estimates are broadcast at most (about 1 KB each); beyond, rows meet them by key and one of SALTS parts.
BROADCAST_GROUPS, SALTS = 10_000, 32
#: The statistics, and the least deviation of each that counts, so that one without spread does not reject all else.
FLOORS = {"word_length": 0.06, "symbols": 0.15, "repeated_lines": 0.16, "repeated_words": 0.14, "punctuation": 0.12, "capitals": 0.20, "digits": 0.20}

_SYMBOLS = [ord(c) for c in "#*$%&|<>"]
_SPACE = [0x20, *range(0x09, 0x0E)]
_PUNCTUATION = [c for c in range(0x21, 0x7F) if not chr(c).isalnum() and c not in _SYMBOLS]
_MEASURED = pa.struct([*((k, pa.int64()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), ("x", pa.list_(pa.int64()))])
_MEASURED_SQL = "struct<n_words: bigint, word_chars: bigint, n_symbols: bigint, n_dup_lines: bigint, n_repeat_words: bigint, x: array<bigint>>"


def measure(text: bytes) -> dict:
    """The counts of a text and its transformed statistics x on the grid (null without words)."""
    words, n = (w := text.split()), len(w)
    count = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    chars = len(text) - int(count[0x80:0xC0].sum()) - int(count[_SPACE].sum())
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeated = len(lines) - len(set(lines))
    windows = list(zip(words, words[1:], words[2:]))
    again = 0
    if len(set(windows)) < len(windows):
        seen: dict = {}
        for v in windows:
            seen[v] = seen.get(v, 0) + 1
        last = 0  # words before this one are counted
        for at, v in enumerate(windows):
            if seen[v] > 1:
                again += at + 3 - max(last, at)
                last = at + 3
    symbols = int(count[_SYMBOLS].sum())
    out = {"n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": repeated, "n_repeat_words": again, "x": None}
    if n:
        upper, lower = int(count[65:91].sum()), int(count[97:123].sum())
        x = (
            math.log(chars / n),
            math.log1p(20 * symbols / n),
            math.sqrt(repeated / len(lines)),
            math.sqrt(again / n),
            math.log(0.05 + int(count[_PUNCTUATION].sum()) / chars),
            math.log(0.05 + upper / (upper + lower + 1)),
            math.log(0.05 + int(count[48:58].sum()) / chars),
        )
        out["x"] = [round(v * GRID) for v in x]
    return out


def measured(docs: DataFrame, name: str, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of every row and a struct ``name`` of its counts and statistics; whole texts, in Arrow batches."""
    spare = f"{name}_text"
    rows = docs.select(*(F.col(f"`{c}`") for c in keep), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias(spare))
    names = [*keep, name]

    def run(batches):
        for b in batches:
            stats = pa.array([measure(b.column(len(keep))[i].as_py()) for i in range(b.num_rows)], _MEASURED)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), stats], names)

    schema = rows.drop(spare).schema.add(name, DataType.fromDDL(_MEASURED_SQL))
    return rows.mapInArrow(run, schema)


def base_failed(m: Column) -> Column:
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEATED * m["n_words"])


def _chi2(q: float, p: int) -> float:
    """Quantile of chi-squared with p degrees, by Wilson and Hilferty."""
    from statistics import NormalDist

    return p * (1 - 2 / (9 * p) + NormalDist().inv_cdf(q) * math.sqrt(2 / (9 * p))) ** 3


def _key(*names: str) -> Column:
    """A group's name. Null is a value of its own."""
    return F.to_json(F.struct(*names))


def _beside(rows: DataFrame, groups: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with the estimates ``groups`` on ``key``. The groups are counted: few are broadcast, so that rows stay where they
    are; of many each is repeated for SALTS parts, so that the rows of one group are not one task's."""
    if groups.count() <= BROADCAST_GROUPS:
        return rows.join(F.broadcast(groups), key, how)
    salt = f"{key}_salt"
    parts = groups.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn(salt, F.floor(F.rand(7) * SALTS).cast("int")).join(parts, [key, salt], how).drop(salt)


def _distance(x: Column, centre: Column, inverse: Column) -> Column:
    """Squared distance of x (inverse: the upper triangle row by row, off the diagonal doubled)."""
    p = len(FLOORS)
    d = [x[i] - centre[i] for i in range(p)]
    total, at = F.lit(0.0), 0
    for i in range(p):
        inner = F.lit(0.0)
        for j in range(i, p):
            inner = inner + inverse[at] * d[j]
            at += 1
        total = total + d[i] * inner
    return F.greatest(total, F.lit(0.0))


def _inflation(p: int) -> float:
    """1 / (share of the variance that the inner share H of a p-variate normal keeps), by Croux and Haesbroeck (1999)."""
    x, k = _chi2(H, p), p + 2
    # P(chi2 with k degrees <= x) by numeric integration
    t = np.linspace(0, x, 20_001)[1:]
    density = np.exp((k / 2 - 1) * np.log(t) - t / 2 - k / 2 * math.log(2) - math.lgamma(k / 2))
    return H / float(density.sum() * (t[1] - t[0]))


_UPPER = [(i, j) for i in range(len(FLOORS)) for j in range(i, len(FLOORS))]
_INFLATION = _inflation(len(FLOORS))
_FLOOR = np.array(list(FLOORS.values())) * GRID


def _square(upper) -> np.ndarray:
    """The symmetric matrix of an upper triangle."""
    out = np.empty((len(FLOORS), len(FLOORS)))
    for (i, j), v in zip(_UPPER, upper):
        out[i, j] = out[j, i] = v
    return out


def _shaped(centre: np.ndarray, scatter: np.ndarray) -> dict:
    """What later steps need of a centre and a scatter."""
    inverse = np.linalg.inv(scatter)
    return {
        "centre": centre.tolist(), "scatter": [float(scatter[i, j]) for i, j in _UPPER], "inverse": [float(inverse[i, j] * (1 if i == j else 2)) for i, j in _UPPER],
        "logdet": float(np.linalg.slogdet(scatter)[1]),
    }


def _concentrated(classes: np.ndarray, counts: np.ndarray, sums: list, target: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
    """Centre and scatter of the share H of rows in the nearest distance classes, drawn to ``target`` (centre, scatter). sums: by
    class those of x and of its products."""
    p, order = len(FLOORS), np.argsort(classes, kind="stable")
    n, wanted = int(counts.sum()), math.ceil(H * int(counts.sum()))
    total, left = np.zeros(p + len(_UPPER), object), wanted
    for at in order:
        if left >= counts[at]:
            total = total + np.array([int(v) for v in sums[at]], object)
            left -= int(counts[at])
        else:
            # the last class: as much of it as is wanted
            total = total + np.array([int(v) for v in sums[at]], object) * left / int(counts[at])
            break
    mean = np.array([v / wanted for v in total[:p]], float)
    scatter = _square([total[p + k] / wanted - mean[i] * mean[j] for k, (i, j) in enumerate(_UPPER)]) * _INFLATION
    if target is not None:
        weight = PRIOR / (n + PRIOR)
        mean, scatter = (1 - weight) * mean + weight * target[0], (1 - weight) * scatter + weight * target[1]
    return mean, scatter


_STATE = "key string, start int, centre array<double>, scatter array<double>, inverse array<double>, logdet double, target array<double>, done boolean"


def _half(values: np.ndarray, counts: np.ndarray) -> float:
    """The median of ascending ``values`` that occur ``counts`` times (the lower one)."""
    return float(values[np.searchsorted(counts.cumsum(), counts.sum() / 2)])


def _starts(rows: DataFrame, targets: DataFrame | None) -> DataFrame:
    """The state of each group and start before the first step; rows: key and x, targets: key and target."""
    p = len(FLOORS)
    values = rows.select("key", F.posexplode("x").alias("at", "value")).groupBy("key", "at", F.expr("value div 8").alias("value")).count()

    def medians(group: pd.DataFrame) -> pd.DataFrame:
        middle, spread = [], []
        for i in range(p):
            own = group[group["at"] == i].sort_values("value")
            v, n = own["value"].to_numpy() * 8.0, own["count"].to_numpy()
            middle.append(_half(v, n))
            off = np.abs(v - middle[-1])
            order = np.argsort(off, kind="stable")
            spread.append(math.hypot(1.4826 * _half(off[order], n[order]), _FLOOR[i]))
        return pd.DataFrame([{"key": group["key"].iloc[0], "middle": middle, "spread": spread}])

    at = settle(values.groupBy("key").applyInPandas(medians, "key string, middle array<double>, spread array<double>"))
    z = [(F.col("x")[i] - F.col("middle")[i]) / F.col("spread")[i] for i in range(p)]
    length = F.sqrt(sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(p)), F.lit(1e-12)))
    signs, bent = [F.col(f"z{i}") / F.col("length") for i in range(p)], [F.tanh(f"z{i}") for i in range(p)]
    exact = lambda v: F.sum(F.round(v * (1 << 20)).cast("long"))
    near = _beside(rows, at, "key").select("key", "middle", "spread", *(v.alias(f"z{i}") for i, v in enumerate(z))).withColumn("length", length)
    both = near.groupBy("key").agg(F.first("middle").alias("middle"), F.first("spread").alias("spread"), F.array(*(exact(v[i] * v[j]) for v in (signs, bent) for i, j in _UPPER)).alias("products"))

    def states(group: pd.DataFrame) -> pd.DataFrame:
        row = group.iloc[0]
        spread, out = np.array(row["spread"]), []
        half = len(_UPPER)
        for start, upper in enumerate((None, row["products"][:half], row["products"][half:])):
            if upper is None:
                correlation = np.eye(p)
            else:
                m = _square(upper) + np.eye(p)
                correlation = m / np.sqrt(np.outer(np.diag(m), np.diag(m)))
            scatter = correlation * np.outer(spread, spread) + np.diag(_FLOOR**2)
            out.append({"key": row["key"], "start": start, **_shaped(np.array(row["middle"]), scatter), "target": None, "done": False})
            out[-1]["logdet"] = math.inf  # of no subset yet
        return pd.DataFrame(out)

    found = both.groupBy("key").applyInPandas(states, _STATE)
    if targets is not None:
        found = found.drop("target").join(targets, "key", "left").select(*(c.split()[0] for c in _STATE.split(", ")))
    return settle(found)


def _stepped(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The states ``found`` after one concentration step; done: those whose determinant it would not lower."""
    p = len(FLOORS)
    sums = [F.col("x")[i] for i in range(p)] + [F.col("x")[i] * F.col("x")[j] for i, j in _UPPER]
    near = _beside(rows, found.select("key", "start", "centre", "inverse"), "key")
    near = near.withColumn("class", F.floor(32 * F.log2(1 + _distance(F.col("x"), F.col("centre"), F.col("inverse")))).cast("int"))
    classes = near.groupBy("key", "start", "class").agg(F.count("*").alias("n"), *(F.sum(v).alias(f"s{i}") for i, v in enumerate(sums)))
    packed = classes.select(F.col("key").alias("of"), F.col("start").alias("start_of"), "class", "n", F.array(*(f"s{i}" for i in range(len(sums)))).alias("sums"))

    def step(own: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        old = state.iloc[0].to_dict()
        given = old["target"]
        target = None if given is None else (np.array(given[:p]), _square(given[p:]))
        mean, scatter = _concentrated(own["class"].to_numpy(), own["n"].to_numpy(), own["sums"].tolist(), target)
        new = {**old, **_shaped(mean, scatter + np.diag(_FLOOR**2))}
        return pd.DataFrame([new if new["logdet"] < old["logdet"] - 1e-9 else {**old, "done": True}])

    return packed.groupBy("of", "start_of").cogroup(found.groupBy("key", "start")).applyInPandas(step, _STATE)


def _estimates(rows: DataFrame, targets: DataFrame | None) -> DataFrame:
    """The MCD of each key of ``rows`` (key, x): (key, centre, scatter, inverse)."""
    found = _starts(rows, targets)
    for _ in range(TRIALS):
        found = settle(_stepped(rows, found))
    least = F.row_number().over(Window.partitionBy("key").orderBy("logdet", "start"))
    open_, parts = settle(found.withColumn("rank", least).where("rank = 1").drop("rank")), []
    for _ in range(STEPS):
        parts.append(open_.where("done"))
        open_ = open_.where("not done")
        if open_.isEmpty():
            break
        open_ = settle(_stepped(rows, open_))
    else:
        parts.append(open_)
    done = parts[0]
    for part in parts[1:]:
        done = done.unionByName(part)
    return settle(done.select("key", "centre", "scatter", "inverse"))


def fit(stats: DataFrame) -> DataFrame:
    """MCD estimates (key, centre array<double>, scatter array<double>, inverse array<double>) of each language and source.

    ``stats`` (settled) has lang, source and x, for the rows to learn from. See ``_key`` for the key."""
    rows = stats.select(_key("lang", "source").alias("pair"), _key("lang").alias("language"), "x")
    languages = _estimates(rows.select(F.col("language").alias("key"), "x"), None)
    targets = rows.groupBy("pair", "language").count().join(languages.withColumnRenamed("key", "language"), "language").select(F.col("pair").alias("key"), F.concat("centre", "scatter").alias("target"))
    return _estimates(rows.select(F.col("pair").alias("key"), "x"), settle(targets))


def judged(rows: DataFrame, name: str, estimates: DataFrame, verdict: str) -> DataFrame:
    """``rows`` (with lang, source and the struct ``name``) and a boolean ``verdict``: whether the text is kept."""
    m, key, e = F.col(name), f"{name}_key", f"{name}_e"
    known = estimates.select(F.col("key").alias(key), F.struct("centre", "inverse").alias(e))
    out = _beside(rows.withColumn(key, _key("lang", "source")), known, key, "left")
    far = F.coalesce(_distance(m["x"], F.col(e)["centre"], F.col(e)["inverse"]) > _chi2(QUANTILE, len(FLOORS)), F.lit(False))
    return out.withColumn(verdict, ~base_failed(m) & ~far).drop(key, e)


def _unused(docs: DataFrame, *names: str) -> list[str]:
    """Names that ``docs`` does not have."""
    taken, out = {c.lower() for c in docs.columns}, []
    for n in names:
        while n.lower() in taken or any(t.startswith(f"{n.lower()}_") for t in taken):
            n += "_"
        out.append(n)
    return out


def verdicts(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    Null and empty texts have no words and fail the plain limits. Null lang and source are values like others. Repeated rows
    give repeated rows; an empty table gives none. Of a language's only row the floors alone are the scatter. Other columns of
    ``docs`` are ignored."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source")
    stats = settle(measured(slim, "m", ["doc_id", "lang", "source"]))
    m = F.col("m")
    found = judged(stats, "m", fit(stats.where(~base_failed(m)).select("lang", "source", m["x"].alias("x"))), "kept")
    return found.select("doc_id", *(m[k].alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), base_failed(m).alias("base_failed"), "kept")


def keep(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text is kept, with its columns. Statistics are measured twice: once to learn from (written
    without texts), once beside the rows, so that no text is shuffled or joined by an id that may repeat."""
    name, verdict = _unused(docs, "quality", "kept")
    slim = docs.select("text", "lang", "source")
    stats = settle(measured(slim, "m", ["lang", "source"]))
    estimates = fit(stats.where(~base_failed(F.col("m"))).select("lang", "source", F.col("m.x").alias("x")))
    return judged(measured(docs, name, docs.columns), name, estimates, verdict).where(verdict).select(*(F.col(f"`{c}`") for c in docs.columns))


def op2_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(table(spark, sf_dir, "documents"))
