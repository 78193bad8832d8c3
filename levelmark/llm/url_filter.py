"""URL rules in a sorted array of digests.

Rules are kept as one file: the 64-bit xxhash of every rule in ascending order,
where its full string lies, its verdict, and the strings. Workers map the file
into memory, hash every stretch of a URL that a rule could name, look all of
them up by one vectorised binary search, and compare the full strings, so that
equal digests of different strings never decide.
"""

import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from levelmark.llm.common import ascii_lower, schema_with
from levelmark.sources.shared import shared_dir

VERDICTS = ("allow", "block")
#: Between host and path of a rule in what is hashed; no URL holds it inside.
SEAM = b"\x00"
_HEAD = np.dtype([("rules", "<u8"), ("text_bytes", "<u8"), ("digest_bits", "<u8")])


def split_rule(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host.lower(), slash + path


def digest(key: bytes, bits: int) -> int:
    return xxhash.xxh64_intdigest(key) >> (64 - bits)


def build_index(rules: Iterable[tuple[str, str]], bits: int = 64) -> bytes:
    """The file for (verdict, rule) pairs; of equal rules the last counts."""
    last = {split_rule(rule): verdict for verdict, rule in rules}
    keys = {host.encode() + SEAM + path.encode(): VERDICTS.index(v) for (host, path), v in last.items()}
    order = sorted(keys, key=lambda k: (digest(k, bits), k))
    ends = np.cumsum([0, *map(len, order)], dtype="<u8")
    head = np.array([(len(order), int(ends[-1]), bits)], dtype=_HEAD)
    digests = np.array([digest(k, bits) for k in order], dtype="<u8")
    verdicts = np.array([keys[k] for k in order], dtype="u1")
    return b"".join([head.tobytes(), digests.tobytes(), ends.tobytes(), *order, verdicts.tobytes()])


class DigestArray:
    """The mapped file."""

    def __init__(self, path: str):
        head = np.memmap(path, _HEAD, "r", shape=(1,))[0]
        n, size, self.bits = int(head["rules"]), int(head["text_bytes"]), int(head["digest_bits"])
        at = _HEAD.itemsize
        empty = np.empty(0, "<u8")
        self.digests = np.memmap(path, "<u8", "r", at, (n,)) if n else empty
        self.ends = np.memmap(path, "<u8", "r", at + 8 * n, (n + 1,))
        self.text = np.memmap(path, "u1", "r", at + 16 * n + 8, (size,)) if size else np.empty(0, "u1")
        self.verdicts = np.memmap(path, "u1", "r", at + 16 * n + 8 + size, (n,)) if n else empty
        # Path lengths a rule has: only such prefixes of a URL's path are probed.
        self.path_bytes = sorted({len(self.key(i).partition(SEAM)[2]) for i in range(n)})
        # Labels and bytes of a rule's host, at most: no longer parent domain is probed.
        hosts = [self.key(i).partition(SEAM)[0] for i in range(n)]
        self.labels = max((h.count(b".") + 1 for h in hosts), default=0)
        self.host_bytes = max(map(len, hosts), default=0)

    def key(self, i: int) -> bytes:
        return self.text[int(self.ends[i]) : int(self.ends[i + 1])].tobytes()

    def find(self, keys: list[bytes]) -> np.ndarray:
        """Position of each key's rule, -1 without one."""
        found = np.full(len(keys), -1, np.int64)
        if not keys or not len(self.digests):
            return found
        wanted = np.fromiter((digest(k, self.bits) for k in keys), np.uint64, len(keys))
        low, high = (np.searchsorted(self.digests, wanted, side) for side in ("left", "right"))
        for at in np.flatnonzero(low < high):
            found[at] = next((i for i in range(low[at], high[at]) if self.key(i) == keys[at]), -1)
        return found


@lru_cache(maxsize=4)
def _mapped(name: str) -> DigestArray:
    return DigestArray(SparkFiles.get(name))


def _candidates(host: str, path: str, index: DigestArray) -> Iterator[bytes]:
    """Every (host or parent domain, path prefix) a rule could consist of: for hosts
    and paths of any length, as many as the rules have labels and path lengths."""
    labels = host.rsplit(".", index.labels) if index.labels else []
    start = len(labels) > index.labels  # then the first part holds the labels beyond
    whole = path[: index.path_bytes[-1]].encode() if labels else b""
    for first in range(start, len(labels)):
        if sum(map(len, labels[first:])) + len(labels) - 1 - first <= index.host_bytes:
            parent = ".".join(labels[first:]).encode()
            for n in index.path_bytes if parent else ():
                if n <= len(whole):
                    yield parent + SEAM + whole[:n]


def _publish(spark: SparkSession, content: bytes) -> str:
    """Stores the file in the shared folder and has every executor fetch it; its name."""
    name = f"url_rules_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/levelmark/{name}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target)
    try:
        out.write(bytearray(content))
    finally:
        out.close()
    spark.sparkContext.addFile(path)
    return name


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without `://`."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), path


def judge(pages: DataFrame, rules: Iterable[tuple[str, str]], default: str = "allow", bits: int = 64) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict.

    A rule `host/path` fits the host and its subdomains where the URL's path
    starts with the rule's path; the rule with the most characters wins, of
    equally long ones the one with the longer host. Without a fitting rule,
    `rule` is null and the verdict is `default`. Null, empty and odd URLs have
    empty host and path; repeated rows are judged one by one. Only page_id and
    url are read. `bits` shortens the digests (for tests of collisions).
    """
    name = _publish(pages.sparkSession, build_index(rules, bits))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _mapped(name)
        for batch in batches:
            keys, owner = [], []
            for row, (host, path) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("host", "path")), strict=True)):
                found = list(_candidates(host, path, index))
                keys += found
                owner += [row] * len(found)
            best: dict[int, tuple] = {}
            places = index.find(keys)
            for at in np.flatnonzero(places >= 0):
                host, _, path = keys[at].decode().partition(SEAM.decode())
                rank = (len(host) + len(path), len(host), host + path, VERDICTS[index.verdicts[places[at]]])
                best[owner[at]] = max(best.get(owner[at], rank), rank)
            won = [best.get(row, (0, 0, None, default)) for row in range(batch.num_rows)]
            made = [pa.array([w[i] for w in won], pa.string()) for i in (2, 3)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, "rule", "verdict"])

    url = F.col("_url")
    host, path = host_and_path(url)
    parsed = pages.select("page_id", F.col("url").alias("_url")).select("page_id", host.alias("host"), path.alias("path"))
    return parsed.mapInArrow(probe, schema_with(parsed, "rule string, verdict string"))

