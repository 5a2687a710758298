"""Token counts by a map-side two-tier lookup.

Tier one is a compact table of the lengths of frequent pre-tokens, made once from a bounded sample of
documents and broadcast. Tier two is a bounded cache in each Python worker; what neither holds is
encoded by the tokenizer library, many pre-tokens at a time. Pre-tokens are never shuffled: the only
stages are the sample, a map whose tasks return their counts packed, and one map over the documents.

The sample affects speed only. Every count equals what the library gives for the whole text. Of a long text
only the distinct pre-tokens are held, and long pre-tokens are not kept from batch to batch.

Cases: a null text counts as empty; an empty text has 0 bytes and 0 tokens; repeated documents are counted
each; an empty table gives an empty result; columns other than the id and the text are not read.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import prepare

#: The pattern by which byte-level BPE of this family splits a text before merging (a fixed value).
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
TABLE_ENTRIES = 65_536
#: Documents of the sample, and the most pre-tokens that one of them adds to it.
SAMPLE_DOCUMENTS, SAMPLE_PRE_TOKENS = 2_000, 1_024
CACHE_ENTRIES = 131_072
#: Texts of more characters are cut one pre-token at a time instead of into a list.
LONG_TEXT = 1 << 20
#: Longer pre-tokens stay out of the table and the caches.
KEPT_LENGTH = 128


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class PreTokenCounter:
    """Counts tokens of texts in one worker. table: pre-token to length."""

    def __init__(self, path: str, table: dict[str, int], cache_entries: int = CACHE_ENTRIES):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.pattern = regex.compile(PRE_TOKEN)
        self.table, self.cache, self.cache_entries = table, {}, cache_entries

    def histogram(self, text: str) -> tuple[Counter, int]:
        """Pre-tokens with their counts, and the number of special strings."""
        parts, n_special = [text], 0
        if self.special and self.special.search(text):
            parts = self.special.split(text)
            n_special = len(parts) - 1
        counts: Counter = Counter()
        for part in parts:
            counts.update(self.pattern.findall(part) if len(part) <= LONG_TEXT else (m.group() for m in self.pattern.finditer(part)))
        return counts, n_special

    def count(self, texts: list[str]) -> list[int]:
        found = [self.histogram(t) for t in texts]
        if len(self.cache) > self.cache_entries:
            self.cache.clear()
        table, cache = self.table, self.cache
        misses = {p for counts, _ in found for p in counts if p not in table and p not in cache}
        if misses:
            listed = list(misses)
            for start in range(0, len(listed), 4096):
                batch = listed[start : start + 4096]
                for p, e in zip(batch, self.tokenizer.encode_batch(batch, add_special_tokens=False)):
                    cache[p] = len(e.ids)
        out = []
        for counts, n in found:
            for p, c in counts.items():
                n += c * (table[p] if p in table else cache[p])
            out.append(n)
        for p in misses:
            if len(p) > KEPT_LENGTH:
                del cache[p]
        return out


_counters: dict[tuple, PreTokenCounter] = {}


def worker_counter(path: str, key: str, packed: tuple[bytes, bytes], cache_entries: int) -> PreTokenCounter:
    """The worker's counter, made once and kept for the tasks that follow; one at a time, to bound memory."""
    if (path, key) not in _counters:
        _counters.clear()
        names, lengths = packed
        table = dict(zip(names.decode().split("\0"), lengths)) if lengths else {}
        _counters[path, key] = PreTokenCounter(path, table, cache_entries)
    return _counters[path, key]


def frequent_pre_tokens(docs: DataFrame, path: str, text: str = "text", entries: int = TABLE_ENTRIES, sample_documents: int = SAMPLE_DOCUMENTS) -> tuple[bytes, bytes]:
    """The compact table: frequent pre-tokens of a bounded sample joined by NUL, and a byte for each length.

    sample_documents bounds the expected sample, and SAMPLE_PRE_TOKENS what each of them sends to the driver; entries
    bounds the table. A pre-token that is long, of over 255 tokens, or with a NUL is left to the caches.
    """
    n = docs.count()
    if n == 0:
        return b"", b""
    sample = docs.select(F.col(text).alias("t")).where(F.col("t").isNotNull()).sample(min(1.0, sample_documents / n), seed=17)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, seen = None, Counter()
        for batch in batches:
            counter = counter or PreTokenCounter(path, {})
            for t in batch.column(0).to_pylist():
                seen.update({p: c for p, c in counter.histogram(t)[0].most_common(SAMPLE_PRE_TOKENS) if len(p) <= KEPT_LENGTH and "\0" not in p})
        if seen:
            top = seen.most_common(entries)
            names = "\0".join(p for p, _ in top).encode()
            yield pa.RecordBatch.from_pydict({"p": [names], "c": [[c for _, c in top]]}, schema=pa.schema([("p", pa.binary()), ("c", pa.list_(pa.int64()))]))

    total: Counter = Counter()
    for r in sample.mapInArrow(local, "p binary, c array<long>").collect():
        total.update(dict(zip(bytes(r.p).decode().split("\0"), r.c)))
    kept = sorted(total, key=lambda p: (-total[p], p))[:entries]
    counter = PreTokenCounter(path, {})
    lengths = [len(e.ids) for e in counter.tokenizer.encode_batch(kept, add_special_tokens=False)] if kept else []
    pairs = [(p, n) for p, n in zip(kept, lengths) if n < 256]
    return "\0".join(p for p, _ in pairs).encode(), bytes(n for _, n in pairs)


def count_tokens(docs: DataFrame, tokenizer: str | None = None, limit: int = 1024, id_column: str = "doc_id", text: str = "text", entries: int = TABLE_ENTRIES, sample_documents: int = SAMPLE_DOCUMENTS, cache_entries: int = CACHE_ENTRIES) -> DataFrame:
    """id, n_bytes, n_tokens and over_limit of every document."""
    spark = prepare(docs.sparkSession)
    path = tokenizer or default_tokenizer()
    key = uuid.uuid4().hex
    packed = spark.sparkContext.broadcast(frequent_pre_tokens(docs, path, text, entries, sample_documents))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = worker_counter(path, key, packed.value, cache_entries)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n = counter.count(texts)
            size = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=[id_column, "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, text).mapInArrow(run, f"`{id_column}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
