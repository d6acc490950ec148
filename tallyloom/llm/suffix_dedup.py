"""Removal of repeated byte strings: a suffix order of anchored contexts.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts elsewhere. Sorting
all suffixes of a corpus would move every byte hundreds of times; anchors make it small
and lose nothing:

1. Of every window of ``LENGTH`` bytes the ``GRAM``-byte string of least hash (leftmost on
   a tie) is its anchor. Equal windows have equal anchors at equal offsets. Neighbouring
   windows mostly share one; an *occurrence* is an anchor with the run of windows that
   chose it, and its *context* the bytes these windows cover.
2. Occurrences meet by the anchor's hash, as packed arrays. Where nothing meets, nothing
   repeats. Occurrences with equal contexts repeat as a whole.
3. What is left, contexts that share an anchor but are not equal (the edges of repeats),
   is sorted: the strings from the anchor on, and those that end with it, read backwards.
   Both orders come from multikey quicksort to a shallow depth, then blind tries, since
   strings with a common anchor agree on ``GRAM`` bytes and more. A window at offset d
   repeats if another context is in the same run of the first order at depth
   LENGTH - d and in the same run of the second at depth GRAM + d.
4. Spans are joined to the texts and cut out.

Equal texts are one text for 2 to 4; of ``LENGTH`` bytes and more they go whole. An
anchor that very many occurrences of one batch share is dealt by context as well; a group
of more than ``MOST_SORTED`` contexts is settled by counting window hashes as rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.suffix_sort import deep_shallow_order, neighbours_common, padded
from tallyloom.llm.tables import partitions, text_or_empty
from tallyloom.llm.words import mix
from tallyloom.session import cut_lineage

LENGTH, GRAM = 200, 64
_PLACES = LENGTH - GRAM + 1  # anchors that a window may choose
HOT_IN_BATCH = 64
MOST_SORTED = 20_000
_BATCH_BYTES = 1 << 20
_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
_FACTORS = mix(np.arange(1001, 1007, dtype=np.uint64)) | np.uint64(1)


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """Hash of the ``GRAM`` bytes from each place on, by doubling."""
    h, k = _BYTE[raw], 1
    for factor in _FACTORS:
        h = h[:-k] * factor + h[k:]
        h ^= h >> np.uint64(29)
        k *= 2
    return mix(h)


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    k = 1
    while 2 * k <= width:
        values = np.minimum(values[:-k], values[k:])
        k *= 2
    return np.minimum(values[: len(values) - (width - k)], values[width - k :]) if width > k else values


def occurrences(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text, anchor hash, context hash, first window, windows, anchor's offset) per occurrence."""
    none = tuple(np.empty(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64, np.int64))
    raw = np.frombuffer(b"".join(texts), np.uint8)
    if len(raw) < LENGTH:
        return none
    lengths = np.array([len(t) for t in texts])
    starts = np.cumsum(lengths) - lengths
    h = gram_hashes(raw)
    # 40 bits of the hash, then the place: the least is leftmost among equals.
    placed = ((h >> np.uint64(24)) << np.uint64(24)) | np.arange(len(h), dtype=np.uint64)
    chosen = _sliding_least(placed, _PLACES)
    text = np.repeat(np.arange(len(texts)), lengths)[: len(chosen)]
    inside = np.flatnonzero(np.arange(len(chosen)) + LENGTH <= (starts + lengths)[text])
    if not len(inside):
        return none
    anchor = (chosen[inside] & np.uint64((1 << 24) - 1)).astype(np.int64)
    text = text[inside]
    new = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]))))
    first = inside[new]
    last = inside[np.append(new[1:], len(inside)) - 1]
    anchor, text = anchor[new], text[new]
    context = ((last - first) * 256 + (anchor - first)).astype(np.uint64)
    end = last + LENGTH
    for place in (first, first + GRAM, first + 2 * GRAM, end - 3 * GRAM, end - 2 * GRAM, end - GRAM):
        context = mix(context + h[place])
    return text, h[anchor], context, first - starts[text], last - first + 1, anchor - first


_FIELDS = ("key", "context", "text", "first", "windows", "offset")
_TYPES = (np.uint64, np.uint64, np.int64, np.int64, np.uint8, np.uint8)
_PACKED = "bucket int, " + ", ".join(f"{f} binary" for f in _FIELDS)
_FOUND = "key long, text_key long, first long, windows int, offset int, open boolean"


def _batches(pdf: pd.DataFrame) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """(text keys, texts) of about ``_BATCH_BYTES`` bytes; one longer text is one batch."""
    keys, texts, size = [], [], 0
    for key, text in zip(pdf["text_key"], pdf["text"]):
        raw = text.encode("utf-8", "surrogatepass")
        if len(raw) < LENGTH:
            continue
        if size + len(raw) > _BATCH_BYTES and texts:
            yield np.array(keys, np.int64), texts
            keys, texts, size = [], [], 0
        keys.append(key)
        texts.append(raw)
        size += len(raw)
    if texts:
        yield np.array(keys, np.int64), texts


def _pieces(keys: np.ndarray, texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """Occurrences of a batch; a text beyond 8 MiB goes in stretches that overlap by ``LENGTH`` - 1 bytes."""
    stretch = 1 << 23
    if len(texts) == 1 and len(texts[0]) > stretch:
        for at in range(0, len(texts[0]) - LENGTH + 1, stretch):
            t, *rest = occurrences([texts[0][at : at + stretch + LENGTH - 1]])
            rest[2] = rest[2] + at
            yield keys[t], *rest
    else:
        t, *rest = occurrences(texts)
        yield keys[t], *rest


def _pack(buckets: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts = [p for keys, texts in _batches(pdf) for p in _pieces(keys, texts)]
            if not parts:
                continue
            text, key, context, first, windows, offset = (np.concatenate(c) for c in zip(*parts))
            order = np.lexsort((first, text, context, key))
            rows = [c[order] for c in (key, context, text, first, windows, offset)]
            fresh = np.ones(len(order), bool)
            fresh[1:] = np.any([r[1:] != r[:-1] for r in rows[:4]], axis=0)
            rows = [r[fresh] for r in rows]
            starts = np.flatnonzero(np.concatenate(([True], rows[0][1:] != rows[0][:-1])))
            counts = np.diff(np.append(starts, len(rows[0])))
            hot = np.repeat(counts >= HOT_IN_BATCH, counts)
            by_context = mix(rows[0] ^ mix(rows[1]))
            to = (np.where(hot, by_context, mix(rows[0])) % np.uint64(buckets)).astype(np.int64)
            to = np.where(hot, -1 - to, to)
            # Of a hot key the bucket of the key gets one occurrence per context.
            lead = np.concatenate(([True], (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1]))) & hot
            sent = [np.concatenate((r, r[lead])) for r in rows]
            to = np.concatenate((to, (mix(rows[0][lead]) % np.uint64(buckets)).astype(np.int64)))
            flagged = np.concatenate((np.zeros(len(hot), bool), np.ones(int(lead.sum()), bool)))
            order = np.argsort(to, kind="stable")
            to, flagged, sent = to[order], flagged[order], [s[order] for s in sent]
            cuts = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1], [True])))
            out = []
            for a, b in zip(cuts[:-1], cuts[1:]):
                out.append(
                    (int(to[a]), *(s[a:b].astype(t).tobytes() for s, t in zip(sent, _TYPES)), flagged[a:b].tobytes())
                )
            yield pd.DataFrame(out, columns=["bucket", *_FIELDS, "hot"])

    return run


def _meet(pdf: pd.DataFrame) -> pd.DataFrame:
    """Occurrences that repeat as a whole (not open), and contexts to be sorted."""
    key, context, text, first, windows, offset = (
        np.frombuffer(b"".join(pdf[f]), t) for f, t in zip(_FIELDS, _TYPES)
    )
    hot = np.frombuffer(b"".join(pdf["hot"]), bool)
    # A lead of a hot key comes after the same occurrence seen otherwise.
    order = np.lexsort((hot, first, text, context, key))
    key, context, text, first, windows, offset, hot = (c[order] for c in (key, context, text, first, windows, offset, hot))
    if len(key):
        fresh = np.concatenate(
            ([True], (key[1:] != key[:-1]) | (context[1:] != context[:-1]) | (text[1:] != text[:-1]) | (first[1:] != first[:-1]))
        )
        key, context, text, first, windows, offset, hot = (c[fresh] for c in (key, context, text, first, windows, offset, hot))
    by_context = int(pdf["bucket"].iloc[0]) < 0
    new_key = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.empty(0, bool)
    new_class = new_key.copy()
    if len(key):
        new_class[1:] |= context[1:] != context[:-1]
    cls, grp = np.cumsum(new_class) - 1, np.cumsum(new_key) - 1
    of_class = np.bincount(cls)[cls] if len(key) else np.empty(0, int)
    # A lead that meets its like here may be alone in its own bucket; seen twice it does no harm.
    whole = of_class > 1
    if by_context:
        # Other contexts of the key are elsewhere: each one's first goes on to be sorted.
        sort = new_class
    else:
        classes = np.bincount(grp[new_class], minlength=grp[-1] + 1 if len(grp) else 0)
        alone = np.bincount(grp[(of_class == 1)], minlength=len(classes))
        sort = new_class & (classes[grp] > 1) & (alone[grp] > 0) if len(key) else new_class
    parts = [(whole, False), (sort, True)]
    out = []
    for rows, to_sort in parts:
        out.append(
            pd.DataFrame(
                {
                    "key": key[rows].view(np.int64) if to_sort else np.zeros(int(rows.sum()), np.int64),
                    "text_key": text[rows],
                    "first": first[rows],
                    "windows": windows[rows].astype(np.int32),
                    "offset": offset[rows].astype(np.int32) if to_sort else np.zeros(int(rows.sum()), np.int32),
                    "open": np.full(int(rows.sum()), to_sort),
                }
            )
        )
    return pd.concat(out, ignore_index=True)


_CONTEXT = "key long, text_key long, first long, windows int, offset int, context binary"


def _contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The bytes of each context to be sorted."""
    for pdf in batches:
        rows = []
        for text_key, text, found in zip(pdf["text_key"], pdf["text"], pdf["found"]):
            raw = text.encode("utf-8", "surrogatepass")
            for f in found:
                at = f["first"]
                rows.append((f["key"], text_key, at, f["windows"], f["offset"], raw[at : at + f["windows"] - 1 + LENGTH]))
        yield pd.DataFrame(rows, columns=["key", "text_key", "first", "windows", "offset", "context"])


def _run_spans(text: np.ndarray, first: np.ndarray, repeats: np.ndarray) -> pd.DataFrame:
    """Spans (text_key, start, end) of the runs of true cells per row; cell j is window first + j."""
    edged = np.zeros((repeats.shape[0], repeats.shape[1] + 2), np.int8)
    edged[:, 1:-1] = repeats
    change = np.diff(edged, axis=1)
    row, a = np.nonzero(change == 1)
    _, b = np.nonzero(change == -1)
    return pd.DataFrame({"text_key": text[row], "start": first[row] + a, "end": first[row] + b - 1 + LENGTH})


def repeated_windows(
    contexts: list[bytes], windows: np.ndarray, offsets: np.ndarray
) -> np.ndarray:
    """Which windows of each context also occur in another one, at the same place from the anchor."""
    n = len(contexts)
    onward = [c[o:] for c, o in zip(contexts, offsets)]
    backward = [c[o + GRAM - 1 :: -1] if o + GRAM - 1 < len(c) else c[::-1] for c, o in zip(contexts, offsets)]
    runs = []
    for strings in (onward, backward):
        lengths = np.array([len(s) for s in strings])
        matrix = padded(strings, int(lengths.max()))
        order = deep_shallow_order(strings, matrix)
        runs.append((order, neighbours_common(matrix, lengths, order)))
    out = np.zeros((n, _PLACES), bool)
    for d in range(_PLACES):
        place = offsets - d
        active = np.flatnonzero((place >= 0) & (place < windows))
        if len(active) < 2:
            continue
        marks = []
        for (order, common), depth in zip(runs, (LENGTH - d, GRAM + d)):
            mark = np.empty(n, np.int64)
            mark[order] = np.cumsum(common < depth)
            marks.append(mark[active])
        both = marks[0] * (n + 1) + marks[1]
        _, inverse, counts = np.unique(both, return_inverse=True, return_counts=True)
        again = active[counts[inverse] > 1]
        out[again, place[again]] = True
    return out


_SPAN = "text_key long, start long, end long"


def _sort_contexts(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.drop_duplicates(["key", "text_key", "first"])
    if len(pdf) < 2:
        return pd.DataFrame({"text_key": [], "start": [], "end": []}).astype("int64")
    repeats = repeated_windows(
        pdf["context"].tolist(), pdf["windows"].to_numpy().astype(np.int64), pdf["offset"].to_numpy().astype(np.int64)
    )
    return _run_spans(pdf["text_key"].to_numpy(), pdf["first"].to_numpy(), repeats)


def _window_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each window of a context as a row with a hash of 128 bits."""
    for pdf in batches:
        rows = []
        for text_key, first, windows, context in zip(pdf["text_key"], pdf["first"], pdf["windows"], pdf["context"]):
            for j in range(windows):
                digest = hashlib.blake2b(context[j : j + LENGTH], digest_size=16).digest()
                rows.append((digest, text_key, first + j))
        yield pd.DataFrame(rows, columns=["window", "text_key", "start"])


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for text_key, text, spans in zip(pdf["text_key"], pdf["text"], pdf["spans"]):
            raw = text.encode("utf-8", "surrogatepass")
            kept, at, removed, runs = [], 0, 0, 0
            reach = -1
            for start, end in sorted((s["start"], s["end"]) for s in spans):
                if start > reach:
                    runs += 1
                    kept.append(raw[at:start])
                    removed += end - start
                    at = reach = end
                elif end > reach:
                    removed += end - reach
                    at = reach = end
            kept.append(raw[at:])
            rows.append((text_key, removed, runs, b"".join(kept)))
        yield pd.DataFrame(rows, columns=["text_key", "n_removed", "n_spans", "kept"])


def _found(texts: DataFrame, buckets: int) -> DataFrame:
    """Whole repeats and contexts to be sorted, written once."""
    packed = texts.mapInPandas(_pack(buckets), _PACKED + ", hot binary")
    return cut_lineage(packed.groupBy("bucket").applyInPandas(_meet, _FOUND))


def repeated_spans(texts: DataFrame, by_key: DataFrame, most_sorted: int = MOST_SORTED) -> DataFrame:
    """(text_key, start, end) in bytes, end exclusive; spans may overlap.

    ``texts`` (text_key, text) may repeat a text with its key; ``by_key`` has each once.
    """
    buckets = partitions(texts.sparkSession)
    found = _found(texts, buckets)
    whole = found.filter(~F.col("open")).select(
        "text_key", F.col("first").alias("start"), (F.col("first") + F.col("windows") - 1 + LENGTH).alias("end")
    )
    to_sort = found.filter("open").dropDuplicates(["key", "text_key", "first"])
    crowded = to_sort.groupBy("key").agg(F.count(F.lit(1)).alias("contexts")).filter(F.col("contexts") > most_sorted)
    lists = to_sort.groupBy("text_key").agg(F.collect_list(F.struct("key", "first", "windows", "offset")).alias("found"))
    contexts = by_key.join(lists, "text_key").mapInPandas(_contexts, _CONTEXT)
    sortable = contexts.join(crowded.select("key"), "key", "left_anti")
    sorted_spans = (
        sortable.withColumn("bucket", F.pmod("key", F.lit(4 * buckets)))
        .groupBy("bucket")
        .applyInPandas(lambda pdf: _sort_contexts(pdf.drop(columns="bucket")), _SPAN)
    )
    out = whole.unionByName(sorted_spans)
    if crowded.limit(1).count():
        rows = contexts.join(crowded.select("key"), "key", "left_semi").mapInPandas(
            _window_rows, "window binary, text_key long, start long"
        )
        often = rows.groupBy("window").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("window")
        counted = rows.join(often, "window", "left_semi").select("text_key", "start", (F.col("start") + LENGTH).alias("end"))
        out = out.unionByName(counted)
    return out


def without_repeats(docs: DataFrame, most_sorted: int = MOST_SORTED, with_kept: bool = False) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): n_bytes, n_removed, n_spans, kept_sha256.

    Texts are their UTF-8 bytes, a NULL text is empty; a text under ``LENGTH`` bytes loses
    nothing. Repeated rows are copies of each other, whatever their doc_id, which may be
    NULL. With ``with_kept`` also the remaining bytes as ``kept``.
    """
    base = docs.select(
        "doc_id", text_or_empty().alias("text")
    ).withColumn("sha", F.sha2(F.col("text").cast("binary"), 256)).withColumn("n_bytes", F.octet_length("text").cast("long"))
    # The key of a text; texts under the length take no part in the search.
    base = base.withColumn("text_key", F.xxhash64("sha", "n_bytes"))
    long_texts = base.filter(F.col("n_bytes") >= LENGTH)
    by_key = long_texts.groupBy("text_key").agg(F.first("text").alias("text"))
    spans = repeated_spans(long_texts.select("text_key", "text"), by_key, most_sorted)
    lists = spans.groupBy("text_key").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    cut = (
        by_key.join(lists, "text_key")
        .mapInPandas(_cut, "text_key long, n_removed long, n_spans long, kept binary")
        .withColumn("kept_sha256", F.sha2("kept", 256))
    )
    if not with_kept:
        cut = cut.drop("kept")
    copies = long_texts.groupBy("sha").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    rows = base.select("doc_id", "sha", "n_bytes", "text_key", *(["text"] if with_kept else []))
    joined = rows.join(copies, "sha", "left").join(cut, "text_key", "left")
    copied = F.col("copies").isNotNull()
    out = joined.select(
        "doc_id",
        "n_bytes",
        F.when(copied, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copied, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copied, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        *(
            [F.when(copied, F.lit("").cast("binary")).otherwise(F.coalesce("kept", F.col("text").cast("binary"))).alias("kept")]
            if with_kept
            else []
        ),
    )
    return out
