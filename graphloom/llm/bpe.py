"""BPE encoding and decoding through a table of distinct words.

White space parts the vocabulary's pretokens whatever else it does, so a text's ids are those of its words in order. Each distinct word of the corpus
is encoded once, in the task that its hash sends it to; ids come back to their positions by the word's place in its chunk's dictionary.
Decoding joins ids with the table of pieces, whose size is that of the vocabulary.
"""

from __future__ import annotations

import functools
import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from graphloom.llm.worddict import code_documents, fill_positions, pack, tasks, unpack, unpack_words


@functools.cache
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.no_padding()
    out.no_truncation()
    return out


@functools.cache
def pieces(path: str) -> pa.Array:
    """The piece of each id behind one space: this vocabulary has no decoder, so decoded pieces are parted by spaces."""
    t = tokenizer(path)
    return pa.array([(" " + (t.id_to_token(k) or "")).encode() for k in range(t.get_vocab_size(with_added_tokens=True))], pa.large_binary())


def require_words(path: str) -> None:
    """Raises unless the tokenizer parts texts at white space whatever else it does, and has no decoder: only then are a text's ids those of its words, and its decoded text their pieces."""
    t = tokenizer(path)
    probe = "The quick  brown\tfox\x0bjumped\x0cover\r\n12 lazy-dogs, wasn't it? "
    ids = t.encode(probe, add_special_tokens=False).ids
    words = [y for x in probe.split() for y in t.encode(x, add_special_tokens=False).ids]
    if ids != words or t.decode(ids, skip_special_tokens=False) != " ".join(t.id_to_token(k) for k in ids):
        raise ValueError(f"{path}: not a vocabulary of words without a decoder")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def word_table(coded: DataFrame, path: str) -> DataFrame:
    """chunk, items and value (numbers of ids, then ids, of each word) of all dictionary rows; equal words meet in one bucket and are encoded once. coded is dealt by key."""
    words = coded.sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, bucket, known = tokenizer(path), None, {}
        for batch in batches:
            values = []
            batch = batch.filter(pc.equal(batch.column("kind"), 0))
            for at, data in zip(batch.column("key").to_pylist(), batch.column("words").to_pylist(), strict=True):
                if at != bucket:
                    bucket, known = at, {}
                words = unpack_words(data)
                new = [w for w in words if w not in known]
                for begin in range(0, len(new), 4096):
                    part = new[begin : begin + 4096]
                    known.update(zip(part, (x.ids for x in t.encode_batch(part, add_special_tokens=False)), strict=True))
                ids = [known[w] for w in words]
                flat = np.fromiter((y for x in ids for y in x), np.int64)
                values.append(len(words).to_bytes(4, "little") + pack(np.concatenate((np.fromiter(map(len, ids), np.int64, len(ids)), flat))))
            yield pa.RecordBatch.from_arrays([batch.column("chunk"), batch.column("items"), pa.array(values, pa.binary())], ["chunk", "items", "value"])

    return words.mapInArrow(run, "chunk long, items binary, value binary")


class _Ids:
    def __init__(self, path: str, with_ids: bool):
        self.path, self.with_ids = path, with_ids

    def prepare(self, items, values):
        """Number of ids and first place among all ids of each code, and the ids."""
        size = sum(map(len, items))
        lengths, begins, flat, at = np.zeros(size, np.int64), np.zeros(size, np.int64), [], 0
        for codes, value in zip(items, values, strict=True):
            n, numbers = int.from_bytes(value[:4], "little"), unpack(value[4:])
            lengths[codes] = numbers[:n]
            begins[codes] = at + np.cumsum(numbers[:n]) - numbers[:n]
            flat.append(numbers[n:].astype("<u4"))
            at += len(flat[-1])
        return lengths, begins, np.concatenate(flat) if flat else np.zeros(0, "<u4")

    def __call__(self, columns, doc_ids, sizes, codes):
        lengths, begins, flat = columns
        n = lengths[codes] if len(codes) else np.zeros(0, np.int64)
        before = np.concatenate(([0], np.cumsum(n)))
        ids = flat[np.repeat(begins[codes] - before[:-1], n) + np.arange(before[-1])] if len(codes) else np.zeros(0, "<u4")
        cuts = before[np.concatenate(([0], np.cumsum(sizes)))]
        decoded = pieces(self.path).take(pa.array(ids.astype(np.int64)))
        text = memoryview(decoded.buffers()[2] or b"")
        ends = np.frombuffer(decoded.buffers()[1], np.int64)[: len(ids) + 1] if len(ids) else np.zeros(1, np.int64)
        raw = memoryview(np.ascontiguousarray(ids)).cast("B") if len(ids) else memoryview(b"")
        ids_sha = [hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        text_sha = [hashlib.sha256(text[ends[a] + (b > a) : ends[b]]).hexdigest() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        out = {"doc_id": doc_ids, "n_tokens": pa.array(np.diff(cuts)), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(text_sha, pa.string())}
        if self.with_ids:
            out["ids"] = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(ids.astype(np.int32)))
            out["decoded"] = pa.array([bytes(text[ends[a] + (b > a) : ends[b]]).decode() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.string())
        yield pa.RecordBatch.from_arrays(list(out.values()), list(out))


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", path: str | None = None, with_ids: bool = True) -> DataFrame:
    """One row for each row of docs: doc_id, n_tokens, ids_sha256 (of little-endian unsigned 32-bit ids), decoded_sha256 (of the decoded text in UTF-8),
    and with with_ids the ids and the decoded text themselves.

    Null and empty texts have no ids and decode to "". Strings of special tokens in a text become those tokens, as the library has it. Repeated rows are encoded
    each; their words are not. An empty table gives an empty result. Other columns aren't read. Raises if the vocabulary isn't one of words, see require_words.
    """
    path = path or default_vocabulary()
    require_words(path)
    # one exchange deals word buckets and documents; its files serve both the encoding and the filling in (ReusedExchange)
    coded = code_documents(docs, id_col, text).repartition(tasks(docs), "key")
    id_type = dict(coded.dtypes)["ids"].removeprefix("array<")[:-1]
    schema = f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    return fill_positions(coded, word_table(coded, path), _Ids(path, with_ids), schema)
