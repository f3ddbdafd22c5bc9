"""Small Column builders shared by the operators."""

from pyspark.sql import functions as F


def draw_key(seed, id_col="id"):
    """Seeded pseudo-random order of rows: the same on every engine and layout."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def array_literal(values):
    """A long double array as one folded literal instead of one node per value."""
    text = ",".join(repr(float(v)) for v in values)
    return F.split(F.lit(text), ",").cast("array<double>")


def rounded(column, digits=6):
    """Round and turn -0.0 into 0.0, so that engines agree on the bits."""
    value = F.round(column, digits)
    return F.when(value == 0, F.lit(0.0)).otherwise(value)


def largest_by_count(count_col, label_col):
    """Ordering struct: highest count first, then the smallest label."""
    return F.struct(count_col.alias("n"), (-label_col).alias("neg_label"))
