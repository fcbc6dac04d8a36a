"""URL verdicts from host and path rules and from a large block list of digests.

The block list is one file: sorted 64-bit xxhash digests of its entries, then where each
entry's text begins, then the texts. Spark sorts the entries and hands the file to every executor, workers map
it into memory (one copy per machine), look digests up by vectorised binary search, and
compare the stored text of each hit, so that two strings with one digest are told apart.
"""

import atexit
import os
import shutil
import tempfile
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ship import ship

#: Most bytes of one list file; it is built on the driver and copied to each executor's disk.
LIST_BYTES = 4 << 30
#: Bytes of probes looked up together.
PROBE_BYTES = 8 << 20
#: Words of host names nobody wants pages from.
UNWANTED = ("ads", "adult", "bets", "betting", "casino", "gambling", "malware", "phishing", "pills", "porn", "spam", "torrent", "warez", "xxx")

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest_of(text: bytes) -> int:
    """As Spark's ``xxhash64`` of the text."""
    return xxhash.xxh64_intdigest(text, seed=42)


class DigestArray:
    """A sorted digest file mapped into memory.

    Numbers of 64 bits: how many entries, host lengths and path lengths there are; these
    lengths in bytes; the digests in order; where each entry's text begins. Then the texts.
    """

    def __init__(self, path: str):
        n, n_hosts, n_paths = np.fromfile(path, dtype=np.uint64, count=3).tolist()
        numbers = np.memmap(path, dtype=np.uint64, mode="r", shape=(4 + n_hosts + n_paths + 2 * n,))
        ends = 3 + n_hosts, 3 + n_hosts + n_paths
        self.hosts, self.paths = (set(x.tolist()) for x in (numbers[3 : ends[0]], numbers[ends[0] : ends[1]]))
        self.digests, self.begins = numbers[ends[1] : ends[1] + n], numbers[ends[1] + n :]
        empty = os.path.getsize(path) == 8 * len(numbers)
        self.texts = np.zeros(0, dtype=np.uint8) if empty else np.memmap(path, dtype=np.uint8, mode="r", offset=8 * len(numbers))

    @staticmethod
    def write(entries, path: str) -> None:
        """Write (digest, text) pairs, which come in the order of unsigned digests.

        They are passed on to disk as they come; only the lengths that occur are kept.
        """
        hosts, paths, n, size = set(), set(), 0, 0
        parts = [f"{path}.{name}" for name in ("digests", "begins", "texts")]
        with open(parts[0], "wb") as digests, open(parts[1], "wb") as begins, open(parts[2], "wb") as texts:
            begins.write((0).to_bytes(8, "little"))
            for digest, text in entries:
                host = text.find(b"/") if b"/" in text else len(text)
                hosts.add(host)
                paths.add(len(text) - host)
                n, size = n + 1, size + len(text)
                if size + 16 * n > LIST_BYTES:
                    raise ValueError(f"the list needs more than {LIST_BYTES} bytes")
                digests.write(digest.to_bytes(8, "little"))
                begins.write(size.to_bytes(8, "little"))
                texts.write(text)
        with open(path, "wb") as file:
            for numbers in ([n, len(hosts), len(paths)], sorted(hosts), sorted(paths)):
                np.array(numbers, dtype=np.uint64).tofile(file)
            for part in parts:
                with open(part, "rb") as done:
                    shutil.copyfileobj(done, file)
                os.remove(part)

    def entry(self, i: int) -> bytes:
        return self.texts[int(self.begins[i]) : int(self.begins[i + 1])].tobytes()

    def find(self, probes: list[bytes], digest=digest_of) -> np.ndarray:
        """Whether each probe is an entry."""
        found = np.zeros(len(probes), dtype=bool)
        if not len(self.digests) or not probes:
            return found
        digests = np.fromiter(map(digest, probes), dtype=np.uint64, count=len(probes))
        at = np.searchsorted(self.digests, digests)
        hits = np.flatnonzero(self.digests[np.minimum(at, len(self.digests) - 1)] == digests)
        for i in hits.tolist():
            j = int(at[i])
            while not found[i] and j < len(self.digests) and self.digests[j] == digests[i]:
                found[i] = self.entry(j) == probes[i]
                j += 1
        return found

    def probes(self, host: bytes, path: bytes) -> list[bytes]:
        """What an entry that covers a URL can be: its host, the domains above it, and for each
        of these its path or a folder above the path. Only lengths that occur in the list
        are tried, so a URL costs no more than these, however long it is."""
        if not host or not self.hosts:
            return []
        begins = [len(host) - n for n in self.hosts if n <= len(host)]
        names = [host[i:] for i in sorted(begins) if i == 0 or host[i - 1 : i] == b"."]
        ends = sorted(n for n in self.paths if 1 < n <= len(path))
        folders = [path[:n] for n in ends if n == len(path) or path[n - 1 : n] == b"/"]
        return names + [name + folder for name in names for folder in folders]


@lru_cache(maxsize=4)
def _mapped(path: str) -> DigestArray:
    return DigestArray(path)


def share_list(entries: DataFrame) -> str:
    """Build the list file from ``entries`` (entry) and give it to every executor.

    Spark makes the entries different and sorts them by digest; the driver passes the
    sorted rows on to a file, one partition after the other. Returns the file's name on
    the executors. Null and empty entries count for nothing.
    """
    context = entries.sparkSession.sparkContext
    name = f"list-{uuid.uuid4().hex}"
    folder = tempfile.mkdtemp(prefix="engagement-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    rows = entries.select("entry").where("entry <> ''").distinct().withColumn("digest", F.xxhash64("entry"))
    # Digests are unsigned: those with the highest bit come last.
    rows = rows.orderBy(F.col("digest") < 0, "digest", "entry")
    pairs = ((row["digest"] % (1 << 64), row["entry"].encode()) for row in rows.toLocalIterator())
    DigestArray.write(pairs, os.path.join(folder, name))
    context.addFile(os.path.join(folder, name))
    return name


def _look_up(name: str):
    def look_up(batches):
        digests = _mapped(SparkFiles.get(name))
        for batch in batches:
            entries, tried, size = [], [], 0

            def settle():
                found, at = digests.find([t for row in tried for t in row]), 0
                for row in tried:
                    hit = np.flatnonzero(found[at : at + len(row)])
                    entries.append(row[hit[0]].decode() if len(hit) else None)
                    at += len(row)
                tried.clear()

            for host, path in zip(*[batch.column(c).to_pylist() for c in ("host", "path")]):
                tried.append(digests.probes(host.encode(), path.encode()))
                size += sum(map(len, tried[-1]))
                if size > PROBE_BYTES:
                    settle()
                    size = 0
            settle()
            columns = [batch.column(c) for c in batch.schema.names] + [pa.array(entries, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "entry"])

    return look_up


def unwanted_hosts(pages: DataFrame, words=UNWANTED) -> DataFrame:
    """entry: of every host of ``pages`` (url) with a label that has one of ``words`` between
    hyphens, that label and the domains above it."""
    label = rf"(?:^|\.)((?:[^.]*-)?(?:{'|'.join(words)})(?:-[^.]*)?\..+)$"
    found = pages.select(F.regexp_extract(url_host(F.col("url")), label, 1).alias("entry"))
    return found.where("entry <> ''").distinct()


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(rules: list[tuple[str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls.

    Rules are (verdict, "host/path"). Of rules of equal length that fit, the one with the
    longer host wins, then a blocking one.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1].find("/"), r[0] == "block")):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], blocked: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict, entry of each row of ``pages`` (page_id, url, ...).

    A rule covers its host and all subdomains where the path starts with the rule's; the
    longest decides. Without a rule, a URL is blocked if an entry of ``blocked`` (entry: a host,
    or a host with a path) names its host or a domain above it, alone or with its path or
    a folder above it; ``entry`` is the first such entry, in this order. A null URL, or one without ``://``,
    has an empty host and path and is allowed. Every row gives one row; repeated rows,
    null page_ids and further columns change nothing. No shuffle.
    """
    ship(pages.sparkSession)
    url = F.col("url")
    parts = pages.select("page_id", url_host(url).alias("host"), url_path(url).alias("path"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parts.schema)
    judged = parts.mapInArrow(_look_up(share_list(blocked)), f"{kinds}, entry string")
    rule, verdict = rule_of(rules, F.col("host"), F.col("path"))
    own = F.when(F.col("entry").isNotNull(), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "entry")
