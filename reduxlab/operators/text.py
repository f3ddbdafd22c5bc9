"""Text cleaning and TF-IDF features."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructType

from ..functions import folds
from ..session import scratch_path, stored

# Fixed value: two or more letters, digits or underscores in any script.
TOKEN = r"[\p{L}\p{N}_]{2,}"
# Lines that introduce or carry quoted text.
QUOTE_LINE = r"(writes in|writes:|wrote:|says:|said:|^In article|^Quoted from|^\||^>)"


def _lines(text):
    return F.split(text, "\n", -1)


def strip_header(text):
    """What follows the first empty line; nothing if there is none."""
    at = F.instr(text, "\n\n")
    return F.when(at > 0, F.substr(text, at + 2)).otherwise(F.lit(""))


def strip_quotes(text):
    return F.array_join(F.filter(_lines(text), lambda line: ~F.rlike(line, F.lit(QUOTE_LINE))), "\n")


def strip_footer(text):
    """Cut at the last line that is empty or dashes only, unless that is the first line.

    White space around the whole text is left out before the lines are looked at.
    """
    lines = _lines(F.regexp_replace(text, r"^\s+|\s+$", ""))
    is_rule = F.transform(lines, lambda line: F.rlike(line, F.lit(r"^\s*-*\s*$")).cast("int"))
    # Lines before the last rule: all lines minus the place of the first rule from the end.
    kept = F.size(lines) - F.array_position(F.reverse(is_rule), 1).cast("int")
    has_rule = F.array_contains(is_rule, 1)
    return F.when(has_rule & (kept > 0), F.array_join(F.slice(lines, 1, kept), "\n")).otherwise(text)


def clean_text(df, remove=("headers", "footers", "quotes"), text_col="text"):
    steps = {"headers": strip_header, "footers": strip_footer, "quotes": strip_quotes}
    for name in ("headers", "footers", "quotes"):
        if name in remove:
            df = df.withColumn(text_col, steps[name](F.col(text_col)))
    return df


def english_stop_words():
    return StopWordsRemover.loadDefaultStopWords("english")


def token_list(text_col, stop_words):
    words = F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(TOKEN), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(list(stop_words))) if stop_words else words


def term_statistics(df, text_col="text", stop_words=()):
    """term, total count and number of documents, in one scan and one small shuffle.

    Tokens are counted batch by batch before they become rows, and both counts are added up
    before the exchange.
    """
    words = df.select(token_list(text_col, stop_words).alias("words"))
    counted = words.mapInArrow(count_terms, "term string, uses long, docs long")
    return counted.groupBy("term").agg(F.sum("uses").alias("uses"), F.sum("docs").alias("docs"))


def count_terms(batches):
    """Batches of token lists -> (term, uses, docs) of each."""
    for batch in batches:
        terms, _, code, uses = counted_cells(batch.column("words"))
        if len(terms):
            total = np.bincount(code, weights=uses, minlength=len(terms)).astype(np.int64)
            docs = np.bincount(code, minlength=len(terms))
            yield pa.RecordBatch.from_arrays([terms, pa.array(total), pa.array(docs)], ["term", "uses", "docs"])


def counted_cells(words):
    """Distinct terms of token lists, and the (row, term number, uses) that occur, row by row."""
    coded = words.flatten().dictionary_encode()
    terms = coded.dictionary
    lengths = words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    width = max(1, len(terms))
    cell, uses = np.unique(np.repeat(np.arange(len(words)), lengths) * width + codes, return_counts=True)
    return terms, *np.divmod(cell, width), uses


class TfIdf:
    """Vocabulary and smoothed inverse document frequencies; rows get unit length."""

    def __init__(self, terms=None, idf=None, table=None, size=None):
        self.terms, self.idf, self.table, self.size = terms, idf, table, size

    def transform(self, df, text_col="text", stop_words=()):
        """Replace the text by idx (ascending) and val."""
        if self.table is not None:
            return self._by_join(df, text_col, stop_words)
        words = df.withColumn("_words", token_list(text_col, stop_words)).drop(text_col)
        vocabulary = pa.array(self.terms, pa.string())
        shared = folds.share(df, (vocabulary, self.idf), vocabulary.nbytes + self.idf.nbytes, "vocabulary")

        @F.arrow_udf("struct<idx: array<int>, val: array<double>>")
        def weigh(words: pa.Array) -> pa.Array:
            known, idf = shared.value
            return weigh_rows(words, known, idf)

        return (
            words.withColumn("_w", weigh("_words"))
            .withColumn("idx", F.col("_w.idx"))
            .withColumn("val", F.col("_w.val"))
            .drop("_w", "_words")
        )

    def _by_join(self, df, text_col, stop_words):
        """For a vocabulary too large to broadcast: join it to the distinct terms of every batch of rows.

        Batches are packed and written once, so equal rows stay apart. Pairs of row and term are never rows:
        a term meets the vocabulary once per batch, and the packed batch moves once, to the terms found for it.
        """
        others = df.drop(text_col)
        words = df.withColumn("_words", token_list(text_col, stop_words)).drop(text_col)
        packed, _ = stored(words.mapInArrow(pack_rows, _PACKED), "texts")
        terms = packed.select(F.col("block").alias("of"), F.posexplode("terms").alias("code", "term"))
        known = terms.join(self.table, "term").select("of", "code", "idx", "idf")
        rows = packed.select("block", "n_terms", "n_rows", "others", "counts")
        schema = StructType(others.schema.fields).add("idx", ArrayType(IntegerType())).add("val", ArrayType(DoubleType()))
        return rows.groupBy("block").cogroup(known.groupBy("of")).applyInArrow(weigh_block, schema)


# A batch of rows: its distinct terms, its columns but the words, and what counts its terms.
_PACKED = "block long, terms array<string>, n_terms int, n_rows int, others binary, counts binary"


def _pack(batch):
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpack(packed):
    return pa.ipc.open_stream(packed).read_all()


def pack_rows(batches):
    """Batches with token lists `_words` -> one row of _PACKED each.

    (row, term) cells are numbered row by row; their steps and uses are small numbers, which compress well.
    """
    block = TaskContext.get().partitionId() << 33
    for batch in batches:
        if not batch.num_rows:
            continue
        terms, row, code, uses = counted_cells(batch.column("_words"))
        steps = np.diff(row * max(1, len(terms)) + code, prepend=0)
        small = [pa.array(v.astype(np.min_scalar_type(v.max(initial=0)))) for v in (steps, uses)]
        others = batch.select([c for c in batch.schema.names if c != "_words"])
        counts = pa.RecordBatch.from_arrays(small, ["step", "uses"])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([block], pa.int64()),
                pa.ListArray.from_arrays(pa.array([0, len(terms)], pa.int32()), terms),
                pa.array([len(terms)], pa.int32()),
                pa.array([batch.num_rows], pa.int32()),
                pa.array([_pack(others)], pa.binary()),
                pa.array([_pack(counts)], pa.binary()),
            ],
            ["block", "terms", "n_terms", "n_rows", "others", "counts"],
        )
        block += 1


def weigh_block(packed: pa.Table, known: pa.Table) -> pa.Table:
    """A packed batch and those of its terms that the vocabulary has -> its rows with idx and val."""
    block = packed.to_pylist()[0]
    place, idf = np.full(block["n_terms"], -1), np.zeros(block["n_terms"])
    code = known["code"].to_numpy()
    place[code], idf[code] = known["idx"].to_numpy(), known["idf"].to_numpy()
    counts = _unpack(block["counts"])
    cell = np.cumsum(counts["step"].to_numpy(), dtype=np.int64)
    row, code = np.divmod(cell, max(1, block["n_terms"]))
    kept = np.flatnonzero(place[code] >= 0)
    kept = kept[np.lexsort((place[code[kept]], row[kept]))]
    row, code = row[kept], code[kept]
    made = _unit_rows(block["n_rows"], row, place[code], counts["uses"].to_numpy()[kept] * idf[code])
    others = _unpack(block["others"])
    columns = [*others.columns, made.field("idx"), made.field("val")]
    return pa.Table.from_arrays(columns, [*others.schema.names, "idx", "val"])


def weigh_rows(words, vocabulary, idf):
    """Token lists of a batch -> sparse rows, counting all rows at once."""
    rows = len(words)
    lengths = words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    place = pc.index_in(words.flatten(), value_set=vocabulary)
    known = pc.is_valid(place).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(rows), lengths)[known]
    idx = place.drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
    cell, uses = np.unique(row * len(idf) + idx, return_counts=True)
    row, idx = np.divmod(cell, len(idf))
    return _unit_rows(rows, row, idx, uses * idf[idx])


def _unit_rows(rows, row, idx, value):
    """Weights sorted by (row, idx) -> lists of every row, of unit length."""
    length = np.sqrt(np.bincount(row, weights=value * value, minlength=rows))
    offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=rows))]).astype(np.int32)
    return pa.StructArray.from_arrays(
        [
            pa.ListArray.from_arrays(offsets, pa.array(idx, pa.int32())),
            pa.ListArray.from_arrays(offsets, pa.array(value / length[row], pa.float64())),
        ],
        ["idx", "val"],
    )


def fit_tfidf(df, text_col="text", stop_words=(), max_features=50_000, min_df=2):
    """Keep terms in at least `min_df` documents, the most used first; number them by name.

    Without `max_features` the vocabulary grows with the corpus: it is then written to the
    shared scratch folder and joined instead of broadcast.
    """
    n_docs = df.count()
    kept = term_statistics(df, text_col, stop_words).filter(F.col("docs") >= min_df)
    idf = F.log((1 + F.lit(n_docs)) / (1 + F.col("docs"))) + 1
    if max_features is None:
        table = _numbered_by_name(kept.select("term", idf.alias("idf")))
        return TfIdf(table=table, size=table.count())
    chosen = kept.orderBy(F.desc("uses"), "term").limit(max_features).select("term", idf.alias("idf")).toArrow()
    chosen = chosen.sort_by("term")
    return TfIdf(chosen["term"].to_pylist(), chosen["idf"].to_numpy(), size=chosen.num_rows)


def _numbered_by_name(terms):
    """Add idx = position by name, from sorted files and the rows before each of them."""
    spark = terms.sparkSession
    path = scratch_path(spark, "vocabulary")
    terms.orderBy("term").write.parquet(path)
    stored = spark.read.parquet(path).select(
        "*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row")
    )
    before = F.sum("n").over(W.orderBy("first").rowsBetween(W.unboundedPreceding, -1))
    # One row per file.
    files = stored.groupBy("file").agg(F.count("*").alias("n"), F.min("term").alias("first"))
    starts = files.select("file", F.coalesce(before, F.lit(0)).alias("start"))
    return stored.join(starts, "file").select("term", "idf", (F.col("start") + F.col("row")).cast("int").alias("idx"))
