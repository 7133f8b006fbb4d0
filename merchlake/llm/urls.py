"""URL filters: host and path rules, and for other URLs the ratio of two character language models.

Each model is a smoothed variable-order Markov model: counts of the next character after contexts of up to ORDER characters, interpolated
from the longest context that was seen down to single characters (Witten-Bell). One is trained on accepted URLs and one on rejected ones;
in `judge` these are the URLs that a rule decides. The log-likelihood difference per character is calibrated on held-out URLs by a
logistic curve, and URLs with a probability of one half or more are allowed.

Models read whole URLs, with the host in lower case and without what stands before it. They count all distinct URLs of their class, but for at most HELD_OUT, which calibrate. The counts stay in
Spark: a model is the table of its runs of ORDER + 1 characters, as shorter contexts are sums over it, and each run that a URL without
a rule holds gets its log-likelihood difference by joins. The COMMON runs that occur most are broadcast, and the others are joined, so
no result depends on COMMON. Differences are summed in fixed point, so in any order. With one class or none to learn from, URLs without a
rule are allowed with a score of 0.5. Null URLs and those without `://` have an empty host and path, and models read nothing or the whole of
them; rules that fit equally long: the last by name; a score of one half is allowed; repeated rows are judged alike; an empty table gives an empty table.
Extra columns stay, but for those that the results replace.
"""

from __future__ import annotations

import string
from collections import Counter, defaultdict
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_batch, materialize, packed, unpacked

ORDER = 4
#: Most URLs of a class that calibrate: every fifth, and no more than these. Runs of characters whose difference is broadcast.
HELD_OUT, COMMON = 2000, 1 << 16
#: Parts of a unit in sums of log-likelihood differences.
PARTS = float(1 << 32)
#: Characters in all, for the uniform distribution below the shortest context.
ALPHABET = 256


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The policy of the registered query.
RULES = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)


def host_of(url: str = "url") -> Column:
    """After the first :// up to a slash, question mark, hash or the end, with A-Z in lower case."""
    found = F.regexp_extract(url, r"://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url: str = "url") -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def text_of(url: str = "url") -> Column:
    """What the models read: the URL from its host on, or all of it without ://."""
    rest = F.regexp_extract(url, r"://[^/?#]*(?s:(.*))", 1)
    return F.coalesce(F.when(F.instr(url, "://") > 0, F.concat(host_of(url), rest)).otherwise(F.col(url)), F.lit(""))


def rule_of(rules: tuple[Rule, ...], host: str = "host", path: str = "path") -> Column:
    """The longest rule that fits, as a struct of its name and verdict; null if none does."""
    out = F.lit(None).cast("struct<name:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((F.col(host) == r.host) | F.col(host).endswith("." + r.host)) & F.col(path).startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


class MarkovModel:
    """Next-character counts by context, mixed over orders by the Witten-Bell weights n / (n + kinds)."""

    def __init__(self, texts: list[str], order: int = ORDER):
        self.order = order
        nested: dict[str, Counter] = defaultdict(Counter)
        for text in texts:
            padded = "\x02" * order + text + "\x03"
            for i in range(order, len(padded)):
                for k in range(order + 1):
                    nested[padded[i - k : i]][padded[i]] += 1
        self.next = {c: (dict(n), n.total(), len(n)) for c, n in nested.items()}

    def log_likelihood(self, text: str) -> float:
        padded, out = "\x02" * self.order + text + "\x03", 0.0
        for i in range(self.order, len(padded)):
            p = 1.0 / ALPHABET
            for k in range(self.order + 1):
                found = self.next.get(padded[i - k : i])
                if found is None:
                    break
                counts, n, kinds = found
                p = (counts.get(padded[i], 0) + kinds * p) / (n + kinds)
            out += np.log(p)
        return out


class Judge(NamedTuple):
    """Both models in memory, for few URLs; `judge` counts the same in Spark."""

    accepted: MarkovModel
    rejected: MarkovModel
    slope: float
    shift: float

    def ratio(self, text: str) -> float:
        """The log-likelihood difference per character."""
        return (self.accepted.log_likelihood(text) - self.rejected.log_likelihood(text)) / (len(text) + 1)

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.ratio(text) + self.shift, -500, 500))))


def calibrate(ratios: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift of a logistic curve by Newton steps; classes weigh alike and the slope is slightly penalised."""
    scale = float(np.abs(ratios).mean()) or 1.0
    x = np.stack([ratios / scale, np.ones_like(ratios)], axis=1)
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    w = np.array([1.0, 0.0])
    penalty = np.diag([0.01, 0.001])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        grad = x.T @ (weight * (p - y)) + penalty @ w
        w = w - np.linalg.solve(x.T @ (x * (weight * p * (1 - p))[:, None]) + penalty, grad)
    return float(w[0] / scale), float(w[1])


def fit(accepted: list[str], rejected: list[str]) -> Judge | None:
    """Models of both classes; every fifth URL is kept for the calibration. None without both classes."""
    if not accepted or not rejected:
        return None
    split = lambda x, held: [t for i, t in enumerate(x) if (i % 5 == 4) == held] if len(x) > 5 else x
    judge = Judge(MarkovModel(split(accepted, False)), MarkovModel(split(rejected, False)), 1.0, 0.0)
    held = [(t, 1) for t in split(accepted, True)] + [(t, 0) for t in split(rejected, True)]
    slope, shift = calibrate(np.array([judge.ratio(t) for t, _ in held]), np.array([y for _, y in held]))
    return judge._replace(slope=slope, shift=shift)


def runs(text: str) -> list[str]:
    """The characters of a text and its end, each after its context of ORDER characters."""
    padded = "\x02" * ORDER + text + "\x03"
    return [padded[i : i + ORDER + 1] for i in range(len(text) + 1)]


def differences(urls: DataFrame) -> DataFrame:
    """(run, difference, n): of each run in the URLs that are asked for, how often it occurs there and how much likelier it is by the
    model of the URLs with own = 1 than by that of own = 0; urls has u, own and asked."""

    def count(batch: pa.RecordBatch) -> list:
        found: dict[str, list[int]] = defaultdict(lambda: [0, 0, 0])
        for u, own, asked in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            at = [0] * (own == 1) + [1] * (own == 0) + [2] * asked
            for run in runs(u):
                for k in at:
                    found[run][k] += 1
        return [(run, *n) for run, n in found.items()]

    sums = lambda df, *by: df.groupBy(*by).agg(*(F.sum(n).alias(n) for n in ("a", "r", "n")))
    longest = materialize(sums(by_batch(urls.select("u", "own", "asked"), count, "run string, a bigint, r bigint, n bigint"), "run"), "runs")
    levels = [longest]
    for k in range(ORDER, 0, -1):
        levels.insert(0, sums(levels[0].withColumn("run", F.substring("run", 2, k)), "run"))
    shorter = None
    for k, level in enumerate(levels):
        level = level.withColumn("context", F.substring("run", 1, k)).withColumn("tail", F.substring("run", 2, k))
        kinds = [f(F.col(n)).alias(f"{name}_{n}") for n in ("a", "r") for f, name in ((F.sum, "all"), (lambda c: F.count_if(c > 0), "kinds"))]
        level = level.join(level.groupBy("context").agg(*kinds), "context").where("n > 0")
        if shorter is None:
            level = level.withColumns({"p_a": F.lit(1.0 / ALPHABET), "p_r": F.lit(1.0 / ALPHABET)})
        else:
            level = level.join(shorter.withColumnRenamed("run", "tail"), "tail")
        mixed = lambda m: F.when(F.col(f"all_{m}") == 0, F.col(f"p_{m}")).otherwise((F.col(m) + F.col(f"kinds_{m}") * F.col(f"p_{m}")) / (F.col(f"all_{m}") + F.col(f"kinds_{m}")))
        shorter = level.select("run", mixed("a").alias("p_a"), mixed("r").alias("p_r"), *(["n"] if k == ORDER else []))
    return shorter.select("run", F.round((F.log("p_a") - F.log("p_r")) * PARTS).cast("bigint").alias("difference"), "n")


def rarely(urls: DataFrame, table: DataFrame, common: dict[str, int]) -> DataFrame:
    """(u, rare): the sum of the differences that are not common, of each distinct URL that has such."""

    def left(batch: pa.RecordBatch) -> list:
        return [(u, run) for u in batch.column(0).to_pylist() for run in runs(u) if run not in shared.value]

    shared = urls.sparkSession.sparkContext.broadcast(common)
    rest = by_batch(urls.select("u"), left, "u string, run string")
    return rest.join(table.select("run", "difference"), "run").groupBy("u").agg(F.sum("difference").alias("rare"))


def ratio(u: str, rare: int | None, common: dict[str, int]) -> float:
    """The log-likelihood difference per character."""
    return (sum(common.get(run, 0) for run in runs(u)) + (rare or 0)) / PARTS / (len(u) + 1)


class Learned(NamedTuple):
    common: dict[str, int]
    slope: float
    shift: float

    def score(self, u: str, rare: int | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * ratio(u, rare, self.common) + self.shift, -500, 500))))


def learn(named: DataFrame) -> tuple[Learned, DataFrame] | None:
    """What scores the URLs that no rule decides, and the differences that are not common to all tasks; named has u and fit."""
    urls = materialize(named.select("u", F.col("fit.verdict").alias("verdict")).distinct(), "urls")
    sizes = dict(urls.where("verdict IS NOT NULL").groupBy("verdict").count().collect())
    if len(sizes) < 2:
        return None
    own, held, y = F.lit(None).cast("int"), F.lit(False), F.col("verdict") == "allow"
    for verdict, n in sizes.items():
        mine = F.col("verdict") == verdict
        if n > 5:
            drawn = urls.where(mine).select(F.xxhash64("u").alias("h")).orderBy("h").limit(min(HELD_OUT, n // 5)).collect()
            out = F.xxhash64("u") <= drawn[-1].h
        else:  # too few to keep any out
            out = F.lit(None).cast("boolean")
        own = F.when(mine & ~F.coalesce(out, F.lit(False)), y.cast("int")).otherwise(own)
        held = held | (mine & F.coalesce(out, F.lit(True)))
    each = urls.select("u", own.alias("own"), held.alias("held"), (held | F.col("verdict").isNull()).alias("asked"), y.alias("y"))
    table = materialize(differences(each), "differences")
    common = {r.run: r.difference for r in table.orderBy(F.desc("n"), "run").limit(COMMON).collect()}
    rare = materialize(rarely(each.where("asked"), table, common), "rare")
    known = sorted((r.u, r.y, r.rare) for r in each.where("held").select("u", "y").join(rare, "u", "left").collect())
    slope, shift = calibrate(np.array([ratio(u, x, common) for u, _, x in known]), np.array([int(y) for _, y, _ in known]))
    return Learned(common, slope, shift), rare


def judge(df: DataFrame, rules: tuple[Rule, ...] = RULES, url: str = "url") -> DataFrame:
    """df with host, path, rule, verdict and score (null where a rule decides)."""
    own = ("host", "path", "rule", "verdict", "score")
    plain = [c for c in df.columns if c not in own]
    named = packed(df, host_of(url).alias("host"), path_of(url).alias("path"), text_of(url).alias("u")).withColumn("fit", rule_of(rules))
    learned = learn(named)
    shared = df.sparkSession.sparkContext.broadcast(learned and learned[0])
    scored = named.join(learned[1], "u", "left") if learned else named.withColumn("rare", F.lit(None).cast("bigint"))
    flat = scored.select("row", "host", "path", F.col("fit.name").alias("rule"), F.col("fit.verdict").alias("verdict"), "rare", "u")

    def run(batch: pa.RecordBatch) -> dict:
        out = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        verdicts, scores = out["verdict"].to_pylist(), []
        for i, (u, rare) in enumerate(zip(out["u"].to_pylist(), out["rare"].to_pylist(), strict=True)):
            score = None
            if verdicts[i] is None:
                score = shared.value.score(u, rare) if shared.value else 0.5
                verdicts[i] = "allow" if score >= 0.5 else "block"
            scores.append(score)
        return out | {"verdict": verdicts, "score": scores}

    done = by_batch(flat, run, ", ".join(f"`{n}` {t}" for n, t in flat.dtypes if n not in ("rare", "u")) + ", score double")
    return unpacked(done, plain, *own)


def op10_urls(pages: DataFrame) -> DataFrame:
    """Every page's host, path, rule and verdict."""
    return judge(pages.select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "score")
