"""URL filters: a blocked Bloom filter of listed canonical URLs, then an exact hash join.

A list entry is a host and the beginning of a path; it fits that host and all its subdomains. A URL
therefore has a bounded number of forms that an entry could equal: its host's suffixes of as many
labels as some entry's host has, each with the beginnings of its path that are as long as some
entry's path. All forms are tested against the filter, 32 bytes an access; only the possible hits
are exploded and joined with the list, which removes the filter's false positives. Longest entries
win. Listed entries are compared in canonical form (:func:`canonical`), rules as they stand.
"""

from __future__ import annotations

import re
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from failscope.llm.common import materialise, table

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: One bit of each of a block's eight 32-bit words is set, chosen by these odd factors.
FACTORS = (0x47B6137B, 0x44974D91, 0x1824AD5B, 0x22B7289D, 0x705495C7, 0x2DF1424B, 0x1EFC4947, 0x5C6BFB31)
#: The filter has 2 ** MAX_LOG_BLOCKS blocks of 32 bytes at most (64 MB); a list too long for it
#: makes more possible hits, which the exact join removes.
MAX_LOG_BLOCKS = 21
#: Entries that a block is made for: 16 bits each.
ENTRIES_A_BLOCK = 16
#: Blocks that come to the driver as one piece of 128 KB.
PIECE_BLOCKS = 1 << 12


def url_host(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?`` or ``#``, A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _UPPER.lower())


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?`` or ``#``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _block(h: Column, log_blocks: int) -> Column:
    return F.shiftrightunsigned(h, 40).bitwiseAND(F.lit((1 << log_blocks) - 1))


_ESCAPE = re.compile("%([0-9A-Fa-f]{2})")
_UNRESERVED = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-._~")


def canonical(host: str, path: str) -> tuple[str, str]:
    """Host and path as the list has them: without user, port and dots at the host's end; escapes of
    unreserved characters decoded and others in capitals, dot segments resolved, the empty path as
    ``/``."""
    host = re.sub(r":[0-9]*\Z", "", host.rpartition("@")[2]).rstrip(".")

    def plain(m: re.Match) -> str:
        code = int(m.group(1), 16)
        return chr(code) if code in _UNRESERVED else m.group().upper()

    path = _ESCAPE.sub(plain, path)
    if "/." in path:
        out: list[str] = []
        segments = path.split("/")[1:]
        for segment in segments:
            if segment == "..":
                del out[-1:]
            elif segment != ".":
                out.append(segment)
        path = "/" + "/".join([*out, *([""] if segments[-1] in (".", "..") and out else [])])
    return host, path or "/"


def _canonical_rows(batches):
    """Rows (page_id, host, path) -> also listed_host and listed_path."""
    for batch in batches:
        both = [canonical(h, p) if h else ("", "") for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([h for h, _ in both], pa.string()), pa.array([p for _, p in both], pa.string())], names=[*batch.schema.names, "listed_host", "listed_path"])


def bits_of(hashes: np.ndarray) -> np.ndarray:
    """For each hash the eight words that its block gets."""
    low = (hashes & np.uint64(0xFFFFFFFF))[:, None]
    return np.uint32(1) << (((low * np.array(FACTORS, dtype=np.uint64)) & np.uint64(0xFFFFFFFF)) >> np.uint64(27)).astype(np.uint32)


def _pieces(batches, log_blocks: int):
    """Rows (piece, h) sorted by piece -> (piece, its blocks as bytes)."""
    at, held = None, None
    size = min(PIECE_BLOCKS, 1 << log_blocks)

    def out():
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([held.tobytes()], pa.binary())], names=["piece", "blocks"])

    for batch in batches:
        pieces, hashes = batch.column("piece").to_numpy(), batch.column("h").to_numpy().view(np.uint64)
        for piece in np.unique(pieces):
            if piece != at:
                if at is not None:
                    yield out()
                at, held = int(piece), np.zeros((size, len(FACTORS)), dtype=np.uint32)
            mine = hashes[pieces == piece]
            block = ((mine >> np.uint64(40)) & np.uint64((1 << log_blocks) - 1)).astype(np.int64) % size
            np.bitwise_or.at(held, block, bits_of(mine))
    if at is not None:
        yield out()


def blocked_bloom(entries: DataFrame, n_entries: int) -> np.ndarray:
    """Filter of the column ``key``: an array of blocks of eight words, filled by tasks in pieces of
    ``PIECE_BLOCKS``; only the pieces, 64 MB at most, come to the driver."""
    log_blocks = min(MAX_LOG_BLOCKS, max(0, (max(n_entries, 1) - 1) // ENTRIES_A_BLOCK).bit_length())
    h = F.xxhash64("key")
    block = F.shiftrightunsigned("h", 40).bitwiseAND(F.lit((1 << log_blocks) - 1))
    hashed = entries.select(h.alias("h")).select("h", F.floor(block / PIECE_BLOCKS).cast("int").alias("piece"))
    pieces = hashed.repartition("piece").sortWithinPartitions("piece").mapInArrow(lambda it: _pieces(it, log_blocks), "piece int, blocks binary")
    filled = np.zeros((1 << log_blocks, len(FACTORS)), dtype=np.uint32)
    for piece, blocks in zip(*(c.to_pylist() for c in pieces.toArrow().columns), strict=True):
        part = np.frombuffer(blocks, dtype=np.uint32).reshape(-1, len(FACTORS))
        filled[piece * PIECE_BLOCKS : piece * PIECE_BLOCKS + len(part)] = part
    return filled


def possible(hashes: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Which of the 64-bit hashes the filter may hold."""
    h = hashes.view(np.uint64)
    bits = bits_of(h)
    return (blocks[((h >> np.uint64(40)) & np.uint64(len(blocks) - 1)).astype(np.int64)] & bits == bits).all(axis=1)


def _possible_places(batches, blocks: np.ndarray):
    """Replaces ``hashes`` by the places (from 0) of those that the filter may hold."""
    for batch in batches:
        lists = batch.column("hashes")
        offsets = lists.offsets.to_numpy()
        flat = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
        hit = possible(flat.astype(np.int64), blocks) if len(flat) else np.zeros(0, dtype=bool)
        before = np.concatenate([[0], np.cumsum(hit)])
        at = np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], np.diff(offsets))
        places = pa.ListArray.from_arrays(pa.array(before[offsets - offsets[0]], pa.int32()), pa.array(at[hit], pa.int32()))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], places], names=[*batch.schema.names[:-1], "places"])


def judge_urls(pages: DataFrame, entries: DataFrame) -> DataFrame:
    """One row for each row of ``pages``: page_id, host, path, rule, verdict, listed.

    ``entries``: host string, path string, verdict ('allow' or 'block'), listed boolean. Listed ones
    are canonical (:func:`listed_entries`) and are compared with the URL's canonical form. Entries
    with listed = false are rules: the longest that fits (host and path together; of equally long
    ones the longer host; of equal ones block) is named in ``rule`` and gives the verdict. Where
    none fits, a URL that a listed entry fits has that entry's verdict and ``listed`` true; all
    others are allowed. Null URLs and URLs without ``://`` have an empty host and path, and no entry
    of a non-empty host fits them. Repeated rows and null page_ids stay; no rows give no rows;
    columns other than page_id and url are ignored.
    """
    spark = pages.sparkSession
    entries = materialise(
        entries.select(
            F.concat(F.when(F.col("listed"), "L").otherwise("R"), "host", "path").alias("key"), F.concat("host", "path").alias("entry"), F.char_length("host").alias("host_len"),
            (F.char_length("host") + F.char_length("path")).alias("len"), F.size(F.split("host", r"\.")).alias("n_labels"), "verdict", "listed",
        ),
        "url-entries",
    )
    sizes = entries.agg(F.count(F.lit(1)).alias("n"), F.collect_set(F.col("len") - F.col("host_len")).alias("lens"), F.coalesce(F.max("n_labels"), F.lit(1)).alias("labels")).first()
    blocks = spark.sparkContext.broadcast(blocked_bloom(entries, sizes.n))  # 64 MB at most
    lens = F.array(*[F.lit(x) for x in sorted(sizes.lens)]) if sizes.lens else F.array().cast("array<int>")

    def forms(kind: str, host: str, path: str) -> Column:
        last = F.reverse(F.slice(F.reverse(F.split(host, r"\.")), 1, sizes.labels))  # no entry has more labels
        suffixes = F.transform(F.sequence(F.lit(1), F.size(last)), lambda i: F.array_join(F.slice(last, i, F.size(last)), "."))
        heads = F.transform(F.filter(lens, lambda x: x <= F.char_length(path)), lambda x: F.substring(F.col(path), F.lit(1), x))
        return F.flatten(F.transform(suffixes, lambda s: F.transform(heads, lambda p: F.concat(F.lit(kind), s, p))))

    kind = pages.schema["page_id"].dataType.simpleString()
    parsed = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    parsed = parsed.mapInArrow(_canonical_rows, f"page_id {kind}, host string, path string, listed_host string, listed_path string")
    every = F.concat(forms("R", "host", "path"), forms("L", "listed_host", "listed_path"))
    schema = f"page_id {kind}, host string, path string, forms array<string>, places array<int>"
    formed = parsed.select("page_id", "host", "path", every.alias("forms")).withColumn("hashes", F.transform("forms", lambda x: F.xxhash64(x)))
    tested = formed.mapInArrow(lambda it: _possible_places(it, blocks.value), schema)
    # written once, so that the row numbers are the same for all who read them
    tested = materialise(tested.withColumn("hits", F.transform("places", lambda i: F.get("forms", i))).drop("places", "forms").withColumn("row_no", F.monotonically_increasing_id()), "url-hits")

    order = F.struct("len", "host_len", (F.col("verdict") == "block").alias("blocks"), F.col("entry").alias("rule"), "verdict")
    exact = tested.select("row_no", F.explode("hits").alias("hit")).join(entries, F.col("hit") == F.col("key"))
    best = exact.groupBy(F.col("row_no").alias("of_row")).agg(F.max(F.when(~F.col("listed"), order)).alias("rule_hit"), F.max(F.when(F.col("listed"), order)).alias("list_hit"))
    judged = tested.join(best, F.col("row_no") == F.col("of_row"), "left")
    return judged.select(
        "page_id", "host", "path", F.col("rule_hit.rule").alias("rule"),
        F.coalesce("rule_hit.verdict", "list_hit.verdict", F.lit("allow")).alias("verdict"),
        (F.col("rule_hit").isNull() & F.col("list_hit").isNotNull()).alias("listed"),
    )


#: The rules of the query.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: The query's list, one URL beginning a line; URLs that one fits are blocked where no rule fits.
LIST_FILE = Path(__file__).with_name("listed_urls.txt")


def listed_entries(lines: DataFrame) -> DataFrame:
    """Entries of a list, as :func:`judge_urls` wants them: column ``value`` has a host and the
    beginning of a path, which are made canonical. Empty lines, and those that begin with ``#``, are
    left out; repeated entries count once."""

    def rows(batches):
        for batch in batches:
            both = []
            for line in batch.column("value").to_pylist():
                line = (line or "").strip()
                if line and not line.startswith("#"):
                    host, _, path = line.partition("/")
                    both.append(canonical(host.lower(), "/" + path))
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in both], pa.string()), pa.array([p for _, p in both], pa.string())], names=["host", "path"])

    return lines.select("value").mapInArrow(rows, "host string, path string").distinct().select("host", "path", F.lit("block").alias("verdict"), F.lit(True).alias("listed"))


def query_entries(spark: SparkSession) -> DataFrame:
    """The query's rules, and the entries of ``LIST_FILE``; lists of any length are read with
    ``spark.read.text`` likewise."""
    rules = spark.createDataFrame([(h, p, v, False) for h, p, v in RULES], "host string, path string, verdict string, listed boolean")
    lines = spark.createDataFrame([(x,) for x in LIST_FILE.read_text().splitlines()], "value string")
    return rules.unionByName(listed_entries(lines))


def op4_url_filter(spark, sf_dir: str) -> DataFrame:
    """All pages: page_id, host, path, rule, verdict."""
    return judge_urls(table(spark, sf_dir, "pages"), query_entries(spark)).drop("listed")


ORACLE = r"""
WITH parsed AS (
    SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
    FROM pages),
ruled AS (
    SELECT *, CASE
        WHEN (host = 'www.example.com' OR suffix(host, '.www.example.com')) AND prefix(path, '/en/') THEN 'www.example.com/en/'
        WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND prefix(path, '/en/') THEN 'example.com/en/'
        WHEN (host = 'net' OR suffix(host, '.net')) AND prefix(path, '/es/') THEN 'net/es/'
        WHEN (host = 'net' OR suffix(host, '.net')) AND prefix(path, '/fr/') THEN 'net/fr/'
        WHEN (host = 'com' OR suffix(host, '.com')) AND prefix(path, '/') THEN 'com/' END AS rule
    FROM parsed)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN regexp_matches(regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '\.+$', ''), '(^|\.)(ads-track|adult-x|casino-win|cheap-pills|free-bets|spam-farm)\.example\.(com|net|org)$') THEN 'block'
    ELSE 'allow' END AS verdict
FROM ruled
"""
