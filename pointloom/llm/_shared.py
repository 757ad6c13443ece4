"""Helpers of the training-data operators: column names, stored tables, word hashes."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: ASCII white space, the only separators of words here (a Java and RE2 character class).
SPACE = r"[ \t\n\x0B\f\r]"
NOT_SPACE = r"[^ \t\n\x0B\f\r]"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below the checkpoint folder, which all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and go on from there.

    The written table outlives executors, is compressed and keeps its statistics, so
    later joins can still choose their strategy by size.
    """
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Texts may be long: send at most so many rows to Python at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, rows)


def digest(c: Column) -> Column:
    """128-bit key of a string."""
    return F.unhex(F.md5(c))


def plain_text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def own_columns(df: DataFrame, *names: str) -> str:
    """A prefix for helper columns that no column of ``df`` starts with."""
    taken = [c.lower() for c in [*df.columns, *names]]
    prefix = "_w"
    while any(c.startswith(prefix) for c in taken):
        prefix += "w"
    return prefix


def as_text(x: str | None) -> bytes:
    return b"" if x is None else x.encode("utf-8", "replace")


# 64-bit hashes of words and word runs, in numpy over a whole batch of texts

_ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit integers (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    if n:
        out[0] = 1
        done = 1
        step = np.uint64(base)
        while done < n:  # doubling: base ** (0 .. done - 1), times base ** done
            take = min(done, n - done)
            out[done : done + take] = out[:take] * step
            done += take
            step = step * step
    return out


_BASE = 0xD1342543DE82EF95  # odd, so it has an inverse modulo 2**64
_POW: dict[str, np.ndarray] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW.get("p", ())) < n:
        with np.errstate(over="ignore"):
            _POW["p"] = _powers(_BASE, max(n, 1 << 16))
            _POW["i"] = _powers(pow(_BASE, -1, 1 << 64), max(n, 1 << 16))
    return _POW["p"], _POW["i"]


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def word_hashes(texts: list[bytes], fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of every text, and the words per text.

    Words are runs of bytes other than ASCII white space; ``fold`` lower-cases A-Z.  The
    hash of a word depends on its bytes alone: sum of byte times power, plus its length.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    joined = b"\n".join(texts) + b"\n"
    raw = np.frombuffer(joined.lower() if fold else joined, np.uint8)
    space = _IS_SPACE[raw]
    edge = np.diff(space.view(np.int8), prepend=np.int8(1))
    starts = np.flatnonzero(edge == -1)
    ends = np.flatnonzero(edge == 1)
    text_ends = np.cumsum(sizes + 1)
    counts = np.diff(np.searchsorted(starts, text_ends), prepend=0)
    if not len(starts):
        return np.empty(0, np.uint64), counts
    with np.errstate(over="ignore"):
        power, inverse = _power_table(len(raw) + 1)
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: len(raw)], out=sums[1:])
        h = (sums[ends] - sums[starts]) * inverse[starts]
        return mixed(h + (ends - starts).astype(np.uint64) * _ODD), counts


def run_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` words; entry i is the run that starts at word i."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(n, np.uint64)
        for j in range(k):
            out = out * np.uint64(_BASE) + words[j : j + n]
        return mixed(out)


def runs_of(texts: list[bytes], most_bytes: int = 1 << 20, most_texts: int = 60_000):
    """Consecutive slices (from, to) of ``texts`` of bounded size; a longer text stands alone."""
    at = size = 0
    for i, t in enumerate(texts):
        if i > at and (size + len(t) > most_bytes or i - at >= most_texts):
            yield at, i
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)


def _long_word_hashes(text: bytes, block: int = 1 << 20) -> np.ndarray:
    """Word hashes of one text of any length, block by block between white space."""
    out, at = [], 0
    while at < len(text):
        end = min(at + block, len(text))
        while end < len(text) and not _IS_SPACE[text[end]]:
            end += 1
        out.append(word_hashes([text[at:end]])[0])
        at = end
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its ``k``-word runs.

    A text with fewer words gives one hash, of all its words; one without words none.
    """
    out: list[np.ndarray] = []
    for i, j in runs_of(texts):
        if j - i == 1:
            words = _long_word_hashes(texts[i])
            counts = np.array([len(words)])
        else:
            words, counts = word_hashes(texts[i:j])
        runs = run_hashes(words, k)
        at = 0
        for n in counts.tolist():
            if n >= k:
                out.append(np.unique(runs[at : at + n - k + 1]))
            elif n:
                out.append(run_hashes(words[at : at + n], n) ^ np.uint64(n))
            else:
                out.append(np.empty(0, np.uint64))
            at += n
    return out


def by_size(small: DataFrame, rows: int, row_bytes: int = 32, most_bytes: int = 64 << 20) -> DataFrame:
    """``small`` ready for a join: broadcast if its counted rows fit the bound, else left to Spark."""
    return F.broadcast(small) if rows * row_bytes <= most_bytes else small


def numbered(df: DataFrame, doc_id: str, name: str) -> DataFrame:
    """``df`` with a unique number per row: the id itself if it is one, else a stored row number.

    Stored, so that a lost task cannot give its rows other numbers.
    """
    c = df.agg(F.count(F.lit(1)).alias("a"), F.countDistinct(doc_id).alias("b")).first()
    if c["a"] == c["b"]:
        return df.withColumn(name, F.col(doc_id).cast("long"))
    return stored(df.withColumn(name, F.monotonically_increasing_id()), "numbered")
