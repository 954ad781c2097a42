"""Scores of benchmarks and what runs cost: names made one, the metric of a row, joins of run tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsieve.plans.reports import percent

#: Benchmarks, by what their name contains, first match first.
BENCHMARKS = {"gqa": "GQA", "science": "ScienceQA", "mmbench": "MMBench", "textvqa": "TextVQA", "pope": "POPE"}
#: Columns that hold the main metric of a row, the best first.
PREFERRED = ("primary_metric_value", "Overall", "overall", "Accuracy", "accuracy", "Acc", "acc", "Score", "score", "F1", "f1")
#: Parts of names of columns that hold no metric.
NO_METRIC = ("fail", "index", "idx", "id", "rank")
#: Parts of names of files that hold predictions, and of files that hold scores.
RAW_FILES = ("prediction", "infer", "detail", "answer", "submission", "tmp", "cache")
SCORE_FILES = ("summary", "score", "acc", "result", "eval", "rating", "overall")
#: Ratios, in per cent, that a folder's name may tell.
RATIOS = (1, 5, 10)
#: How the six recalls of an evaluation are called in a report.
RECALLS = {"txt_r1": "i2t_r1", "txt_r5": "i2t_r5", "txt_r10": "i2t_r10", "img_r1": "t2i_r1", "img_r5": "t2i_r5", "img_r10": "t2i_r10"}
LEAST = 1e-8


def benchmark(name: Column) -> Column:
    """The benchmark that a name tells, or null."""
    return F.coalesce(*[F.when(F.contains(F.lower(name), F.lit(part)), F.lit(full)) for part, full in BENCHMARKS.items()])


def ratio(value: Column, folder: Column) -> Column:
    """Per cent as a whole number: from a share, from per cent, or else from the folder."""
    x = value.cast("string").try_cast("double")
    low = F.lower(folder)
    told = F.coalesce(*[F.when(F.contains(low, F.lit(f"_{r}")) | F.contains(low, F.lit(f"ratio_{r:02d}")), F.lit(r)) for r in RATIOS])
    own = F.when((x > 0) & (x < 1), F.bround(x * 100)).when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(F.bround(x))
    return F.coalesce(own.cast("int"), told)


def mode(value: Column, folder: Column) -> Column:
    """ours or random: as given, or else from the folder; anything else stays."""
    raw = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    low = F.lower(folder)
    return F.when(raw.isin("ours", "random"), raw).when(F.contains(low, F.lit("random")), "random").when(F.contains(low, F.lit("ours")), "ours").otherwise(raw)


def main_metric(df: DataFrame) -> Column:
    """The metric of a row in per cent: the first of PREFERRED with a number, else the first other column with one."""
    first = [c for c in PREFERRED if c in df.columns]
    rest = [c for c in df.columns if c not in first and not any(part in c.lower() for part in NO_METRIC)]
    found = [percent(F.col(f"`{c}`").cast("string")) for c in [*first, *rest]]
    return F.coalesce(*found) if found else F.lit(None).cast("double")


def holds_scores(file: Column) -> Column:
    """Whether a file's name says that it holds scores rather than predictions; a spreadsheet of one benchmark must say more."""
    name = F.lower(F.element_at(F.split(file, "/"), -1))
    has = lambda parts: name.rlike("|".join(parts))
    sheet = name.rlike(r"\.xlsx?$") & benchmark(name).isNotNull()
    return ~has(RAW_FILES) & F.when(sheet, has(("_acc", "_score", "_result", "summary"))).otherwise(has(SCORE_FILES))


def mean_of(columns: list[str]) -> Column:
    """Mean of those of the columns that are not null; null if all are."""
    there = [F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in columns]
    total = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns]
    n = reduce(Column.__add__, there)
    return F.when(n > 0, reduce(Column.__add__, total) / n)


def first_alias(df: DataFrame, names: list[str]) -> Column:
    """The first of several names of one metric that is there and not null."""
    have = [F.col(f"`{n}`").cast("string").try_cast("double") for n in names if n in df.columns]
    return F.coalesce(*have) if have else F.lit(None).cast("double")


def as_report(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed(RECALLS)


def grid(axes: list[DataFrame]) -> DataFrame:
    """All combinations of a few short tables of settings."""
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), axes)


def found_and_missing(wanted: DataFrame, rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows of the wanted settings, and the settings without any."""
    return rows.join(wanted.select(*keys), keys, "left_semi"), wanted.join(rows.select(*keys).distinct(), keys, "left_anti")


def first_there(candidates: DataFrame, there: DataFrame, key: str, path: str = "path", order: str = "nth") -> DataFrame:
    """(key, path): the first candidate(key, order, path) that is there, or null if none is."""
    got = candidates.join(there.select(path).distinct().withColumn("there", F.lit(True)), path, "left")
    return got.groupBy(key).agg(F.min_by(F.when(F.col("there"), F.col(path)), F.when(F.col("there"), F.col(order))).alias(path))


def settings(specs: DataFrame, column: str) -> DataFrame:
    """label|kind|scales|variant[|root] as columns; scales as an array of numbers."""
    part = F.split(F.col(column), r"\|")
    names = ("label", "kind", "scales", "variant", "root")
    out = specs.withColumns({n: F.trim(F.get(part, F.lit(k))) for k, n in enumerate(names)})
    return out.withColumn("scales", F.transform(F.filter(F.split("scales", "[, ]+"), lambda x: x != ""), lambda x: x.try_cast("int")))


def with_metrics(manifest: DataFrame, metrics: DataFrame, key: str) -> DataFrame:
    """Every run of a manifest, with its metrics or nulls."""
    return manifest.join(metrics, key, "left")


def by_precedence(tables: list[DataFrame], key: str, fields: list[str]) -> DataFrame:
    """Rows of the first table; each field from the first table in which it is not null."""
    out = tables[0].select(key, *[F.col(f).alias(f"{f}_0") if f in tables[0].columns else F.lit(None).alias(f"{f}_0") for f in fields])
    for k, t in enumerate(tables[1:], 1):
        out = out.join(t.select(key, *[F.col(f).alias(f"{f}_{k}") for f in fields if f in t.columns]), key, "left")
    have = lambda f: [F.col(c) for c in (f"{f}_{k}" for k in range(len(tables))) if c in out.columns]
    return out.select(key, *[F.coalesce(*have(f)).alias(f) for f in fields])


def derived(runs: DataFrame, recall: str, seconds: str, energy: str, base_seconds: str, base_energy: str) -> DataFrame:
    """runs with recall per watt-hour and per second, speedup and the energy saved against a baseline; null without their inputs."""
    least = lambda c: F.greatest(F.col(c).cast("double"), F.lit(LEAST))
    have = lambda *cs: reduce(Column.__and__, [F.col(c).isNotNull() for c in cs])
    return runs.withColumns({
        "recall_per_wh": F.when(have(recall, energy), F.col(recall) / least(energy)),
        "recall_per_second": F.when(have(recall, seconds), F.col(recall) / least(seconds)),
        "speedup": F.when(have(base_seconds, seconds) & (F.col(seconds) != 0), F.col(base_seconds) / least(seconds)),
        "energy_saved": F.when(have(base_energy, energy), 1 - F.col(energy) / least(base_energy)),
    })


def normal_results(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """Runs with any metric; GPU hours from seconds and GPUs, total energy from its parts, where they are not given."""
    hours = F.coalesce("gpu_hours", F.col("seconds") * F.coalesce("gpus", F.lit(1)) / 3600)
    parts = F.when(F.col("gpu_wh").isNotNull() | F.col("cpu_wh").isNotNull(), F.coalesce("gpu_wh", F.lit(0.0)) + F.coalesce("cpu_wh", F.lit(0.0)))
    return rows.where(F.coalesce(*[F.col(m).isNotNull() & F.lit(True) for m in metrics]) if len(metrics) == 1 else reduce(Column.__or__, [F.col(m).isNotNull() for m in metrics])).withColumns({"gpu_hours": hours, "total_wh": F.coalesce("total_wh", parts)})


def status(methods: DataFrame, documented: DataFrame, configured: DataFrame, key: str = "method") -> DataFrame:
    """(method, documented, configured, ready) for each method."""
    flag = lambda df, n: df.select(key).distinct().withColumn(n, F.lit(True))
    out = methods.select(key).distinct().join(flag(documented, "documented"), key, "left").join(flag(configured, "configured"), key, "left").fillna(False, ["documented", "configured"])
    return out.withColumn("ready", F.col("documented") & F.col("configured"))
