"""Search over many files that reads only those which can hold the term.

``SearchIndex`` keeps, for each file and column, which pieces of three bytes its
lower-cased cells hold (in UTF-8), as a bit array of ``BITS`` hashed places
(``PIECE`` of them a row).  A term's own pieces all stand in a file that holds the term, so
files that lack one are not read; the others are searched as usual, and the
result is that of ``table.search`` over all files.  Files are told apart by
path, length and time of modification; ``update`` reads the files that the
index doesn't know, and ``search`` reads those without an index as they are.

Terms of fewer than three letters, and patterns without three fixed letters in
a row (or with groups, alternatives or classes that leave none), read all
files.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import predicates as P
from ..operators.table import search
from .profile_store import files_under

#: Hashed places of a file and column; places in one row of the index (those of Spark's bitmap functions).
SHIFT = 18
BITS, PIECE = 1 << SHIFT, 1 << 15
#: Files and columns whose bits a task holds at once.
HELD = 64
#: Folder of the index's rows, by how places are found: rows of another way are not read.
WAY = "three_bytes"
STATE = "file string, length bigint, modified bigint, column string, part bigint, bits binary"
KEYS = ["file", "length", "modified"]


def _places(data):
    """Place of each three-byte piece of ``data``, a numpy array of bytes."""
    import numpy as np
    x = data.astype(np.uint32)
    return ((x[:-2] | x[1:-1] << 8 | x[2:] << 16) * np.uint32(0x9E3779B1)) >> np.uint32(32 - SHIFT)


def _set_bits(names: list[str]):
    """Batches of ``file`` and cells to rows of (file, column, part, bits).  Bytes are hashed a block at a time, straight from
    the Arrow buffers; a task holds the bits of ``HELD`` files and columns at most and then gives them out."""
    bits, piece, held, places = BITS, PIECE, HELD, _places  # Python of an executor needs no module of ours

    def run(batches):
        import numpy as np
        import pyarrow as pa
        seen: dict = {}

        def rows():
            out: list = [[], [], [], []]
            for (file, column), marks in seen.items():
                for part, row in enumerate(np.packbits(marks, bitorder="little").reshape(-1, piece // 8)):
                    if row.any():
                        for to, v in zip(out, (file, column, part, row.tobytes())):
                            to.append(v)
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64()),
                                               pa.array(out[3], pa.binary())], ["file", "column", "part", "bits"])

        for batch in batches:
            if not batch.num_rows:
                continue
            files = batch.column(0).dictionary_encode(null_encoding="encode")
            at = files.indices.to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])  # runs of rows of one file
            for start, end in zip(starts, np.r_[starts[1:], len(at)]):
                file = files.dictionary[int(at[start])].as_py()
                for i, name in enumerate(names):
                    cells = batch.column(i + 1).cast(pa.large_binary())
                    ends = np.frombuffer(cells.buffers()[1], np.int64)[cells.offset + start:cells.offset + end + 1]
                    if ends[-1] - ends[0] < 3:
                        continue
                    data = np.frombuffer(cells.buffers()[2], np.uint8)
                    marks = seen.setdefault((file, name), np.zeros(bits, bool))
                    for low in range(int(ends[0]), int(ends[-1]) - 2, 1 << 20):
                        high = min(low + (1 << 20) + 2, int(ends[-1]))
                        whole = np.ones(high - low - 2, bool)  # pieces that lie in one cell
                        cuts = ends[np.searchsorted(ends, low, "right"):np.searchsorted(ends, high, "left")] - low
                        for back in (1, 2):
                            over = cuts - back
                            whole[over[(over >= 0) & (over < len(whole))]] = False
                        marks[places(data[low:high])[whole]] = True
                if len(seen) >= held:
                    yield rows()
        yield rows()

    return run


def file_pieces(df: DataFrame, file: str, all_types: bool = False) -> DataFrame:
    """(file, column, part, bits) of a table whose column ``file`` names each row's file; bits are set before the shuffle."""
    fields = [f for f in df.schema.fields if f.name != file and (all_types or P.is_string(f.dataType))]
    if not fields:
        return df.sparkSession.createDataFrame([], "file string, column string, part bigint, bits binary")
    cells = [F.lower(P.as_text(P.quoted(f.name), f.dataType)).cast("binary").alias(f"c{i}") for i, f in enumerate(fields)]
    found = df.select(F.col(P.quoted(file)).alias("file"), *cells).mapInArrow(
        _set_bits([f.name for f in fields]), "file string, column string, part bigint, bits binary")
    return found.groupBy("file", "column", "part").agg(F.expr("bitmap_or_agg(bits)").alias("bits"))


def fixed_parts(pattern: str) -> list[str]:
    """Strings that every match of a pattern holds; none where the pattern is not a plain sequence."""
    if any(c in pattern for c in "|(){}"):
        return []
    parts, now, i = [], "", 0
    while i < len(pattern):
        c, literal = pattern[i], None
        if c == "\\" and i + 1 < len(pattern):
            i += 1
            literal = None if pattern[i].isalnum() else pattern[i]
        elif c == "[":
            end = pattern.find("]", i + 2 + (pattern[i + 1:i + 2] == "^"))
            if end < 0 or "[" in pattern[i + 1:end] or "\\" in pattern[i:end]:
                return []
            i = end
        elif c not in ".^$*+?":
            literal = c
        i += 1
        after = pattern[i:i + 1]
        if literal is not None and after not in ("*", "?"):
            now += literal
        if literal is None or after in ("*", "?", "+"):
            parts.append(now)
            now = ""
        while pattern[i:i + 1] and pattern[i] in "*+?":
            i += 1
    return [p for p in [*parts, now] if len(p) >= 3]


class SearchIndex:
    """Rows of ``STATE`` under ``folder`` (shared storage, any file system Spark knows)."""

    def __init__(self, spark: SparkSession, folder: str, all_types: bool = False):
        self.spark, self.folder, self.all_types = spark, f"{folder.rstrip('/')}/{WAY}", all_types

    def states(self) -> DataFrame:
        jvm, sc = self.spark.sparkContext._jvm, self.spark.sparkContext
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        if not path.getFileSystem(sc._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], STATE)
        return self.spark.read.schema(STATE).parquet(self.folder)

    def _listed(self, files) -> DataFrame:
        return self.spark.createDataFrame(files, "file string, length bigint, modified bigint")

    def update(self, files: list[tuple[str, int, int]]) -> list[str]:
        """Reads those of ``files`` that the index doesn't hold as they are now, and returns their paths."""
        new = [r.file for r in self._listed(files).join(self.states().select(*KEYS).distinct(), KEYS, "left_anti").collect()]
        if new:
            df = self.spark.read.parquet(*sorted(new))
            rows = file_pieces(df.select(*[F.col(P.quoted(c)) for c in df.columns], F.col("_metadata.file_path").alias("__file")), "__file", self.all_types)
            local = F.regexp_replace("file", "^file:/+", "file:/")
            listed = self._listed([f for f in files if f[0] in set(new)]).withColumn("_f", local)
            kept = listed.join(rows.withColumn("file", local).withColumnRenamed("file", "_f"), "_f", "left")  # a file without text has a row too
            kept.select("file", "length", "modified", "column", "part", "bits").write.mode("append").parquet(self.folder)
        return sorted(new)

    def candidates(self, files, parts: list[str], columns=None) -> list[str]:
        """The paths of ``files`` that may hold all of ``parts``, together in one column; files that are not indexed too."""
        if not parts or not files:
            return [f[0] for f in files]
        places = {int(k) for p in parts if len(p.encode()) >= 3 for k in _places(np.frombuffer(p.encode(), np.uint8))}
        wanted = [(k // PIECE, k % PIECE) for k in sorted(places)]  # no more than the term's letters
        if not wanted:
            return [f[0] for f in files]
        asked = F.array(*[F.struct(F.lit(part).alias("part"), F.lit(bit // 8 + 1).alias("byte"), F.lit(1 << bit % 8).alias("mask")) for part, bit in wanted])
        held = self.states().join(self._listed(files), KEYS)
        indexed = held.select("file").distinct()
        here = F.size(F.filter(asked, lambda w: (w["part"] == F.col("part")) & (
            F.conv(F.hex(F.substring("bits", w["byte"], F.lit(1))), 16, 10).cast("int").bitwiseAND(w["mask"]) != 0)))
        if columns is not None:
            held = held.where(F.col("column").isin(list(columns)))
        # an index row may stand twice where two updates met; its bits are the same
        full = (held.where("column IS NOT NULL").groupBy("file", "column", "part").agg(F.max(here).alias("n"))
                .groupBy("file", "column").agg(F.sum("n").alias("n")).where(F.col("n") == len(wanted)).select("file").distinct())
        out = self._listed(files).select("file").distinct()
        keep = out.join(indexed, "file", "left_anti").union(out.join(full, "file", "left_semi"))
        return sorted(r.file for r in keep.collect())

    def search(self, path: str, term: str, regex: bool = False, all_types: bool = False, columns=None) -> DataFrame:
        """``table.search`` over the Parquet files below ``path``; reads only those that can hold the term."""
        files = files_under(self.spark, path)
        whole = self.spark.read.parquet(path)
        if not term or (all_types and not self.all_types):
            return search(whole, term, regex, all_types, columns)
        parts = fixed_parts(term.lower()) if regex else [term.lower()] if len(term.lower()) >= 3 else []
        paths = self.candidates(files, parts, columns)
        if len(paths) == len(files):
            return search(whole, term, regex, all_types, columns)
        found = self.spark.read.schema(whole.schema).parquet(*paths) if paths else whole.limit(0)
        return search(found, term, regex, all_types, columns)
