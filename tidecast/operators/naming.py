"""Labels of systems and runs, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The published labels of model families and of preparation sheets.
SHEET_CODES = {0: "L1", 1: "L24", 2: "L168"}
SHEET_LAGS = {0: "lag 1 h", 1: "lags 1 and 24 h", 2: "lags 1, 24, and 168 h"}
SHEET_MATRICES = {0: "1-h", 1: "1- and 24-h", 2: "1-, 24-, and 168-h"}
LABELS = {
    "lagdrop": ("No-history", "No target history, 38 exogenous predictors (No-history)", "No target history"),
    "mi_top_k_nolags": ("MI-9", "Mutual-information selection, 9 exogenous predictors (MI-9)", "MI-9"),
    "sfs_shared": ("SFS-shared", "SFS, shared P-Q tuning (SFS-shared)", "SFS"),
}
NAIVE = {24: ("SNaive-24", "Previous-day seasonal-naive benchmark (SNaive-24)"), 168: ("SNaive-168", "Previous-week seasonal-naive benchmark (SNaive-168)")}
PLACES = {"rmse": 2, "mae": 2, "wmape": 2, "mase": 3, "joint": 4}


def canonical_target(name: Column) -> Column:
    """P_Power or Q_Power for any spelling of the two; null for other names."""
    low = F.lower(name)
    return F.when(low.isin("p", "p_power"), "P_Power").when(low.isin("q", "q_power"), "Q_Power")


def run_label(explicit: Column, selector: Column, shared: Column, policy: Column) -> Column:
    """The family name of a run: its explicit label, else what selector, sharing and lag policy make of it."""
    selector, shared, policy = F.coalesce(selector, F.lit("all")), F.coalesce(shared, F.lit(True)), F.coalesce(policy, F.lit("mutual"))
    sfs = F.when(shared, "SFS_shared").otherwise("SFS")
    chosen = F.when(policy == "drop", "mi_top_k_nolags").otherwise("mi_top_k")
    plain = F.when(policy == "drop", "LagDrop").when(policy == "own", "own_lags").when(shared, "Shared_mutual_lags").otherwise("mutual_lags")
    return F.when(F.coalesce(explicit, F.lit("")) != "", explicit).when(selector.startswith("sfs"), sfs).when(selector == "mi_top_k", chosen).otherwise(plain)


def lag_policy(token: Column) -> Column:
    """drop, own or mutual, from a token of a file's name; null where it tells nothing."""
    low = F.lower(token)
    return F.when(low.rlike("lagdrop|no_?lags"), "drop").when(low == "own", "own").when(low.contains("mutual"), "mutual")


def _of_sheet(table: dict[int, str], sheet: Column, other: Column) -> Column:
    out = other
    for k, text in table.items():
        out = F.when(sheet == k, F.lit(text)).otherwise(out)
    return out


def publication_labels(systems: DataFrame, clean: Column) -> DataFrame:
    """systems (family, sheet, lag_policy, ...) with short, long and group labels; clean is the label of unknown families."""
    family, sheet = F.lower("family"), F.col("sheet")
    number = sheet.cast("string")
    code = _of_sheet(SHEET_CODES, sheet, F.concat(F.lit("L"), number))
    lags = _of_sheet(SHEET_LAGS, sheet, F.concat(F.lit("preparation sheet "), number))
    matrix = _of_sheet(SHEET_MATRICES, sheet, F.concat(F.lit("sheet-"), number))
    digits = F.regexp_extract(F.coalesce("lag_policy", F.lit("")), "([0-9]+)", 1)
    lag = F.when(digits != "", digits).otherwise(number).cast("int")

    def history(prefix: str, text: str) -> Column:
        short = F.concat(F.lit(f"{prefix}-"), code)
        return F.struct(short.alias("short"), F.concat(F.lit(f"{text}, "), lags, F.lit(" ("), short, F.lit(")")).alias("long"), F.lit(text).alias("group"))

    prepared = F.concat(F.lit("SFS-"), code, F.lit("-prep"))
    label = F.when(family.isin("mutual_lags", "shared_mutual_lags"), history("MUT", "Mutual history")).when(family == "own_lags", history("OWN", "Own history"))
    for name, (short, text, group) in LABELS.items():
        label = label.when(family == name, F.struct(F.lit(short).alias("short"), F.lit(text).alias("long"), F.lit(group).alias("group")))
    label = label.when(family == "sfs", F.struct(prepared.alias("short"), F.concat(F.lit("SFS, "), matrix, F.lit(" preparation matrix ("), prepared, F.lit(")")).alias("long"), F.lit("SFS").alias("group")))
    for k, (short, text) in NAIVE.items():
        label = label.when((family == "baseline") & (lag == k), F.struct(F.lit(short).alias("short"), F.lit(text).alias("long"), F.lit("Seasonal naive").alias("group")))
    label = label.otherwise(F.struct(clean.alias("short"), clean.alias("long"), F.regexp_replace("family", "_", " ").alias("group")))
    return systems.withColumn("_l", label).select("*", "_l.short", "_l.long", "_l.group").drop("_l")
