"""Token ids in binary shards: whole texts are encoded, shards are wavelet matrix files in ascending document order."""

from __future__ import annotations

import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import by_file, new_path, prefix_sums, written
from shelfmark.llm.wavelet import pack, unpack

#: Ids of a shard (a longer document is a shard of its own); bytes of text encoded at once; entries of a memo's half.
SHARD_TOKENS, BITE, MEMO = 1 << 20, 8_000_000, 300_000
#: A text where a space has white space beside it, or begins or ends the text. White space of either library counts.
_ODD = r"(^|[\s\pZ\x{0B}\x{85}\x{1C}-\x{1F}]) |  | ([\s\pZ\x{0B}\x{85}\x{1C}-\x{1F}]|$)"
_SAFE = re.compile(r"(?<=\S) (?=\S)")


class Memo:
    """Results by key, bounded: when the young half is full, the old half goes; what is used again stays."""

    def __init__(self, make, most: int = MEMO):
        self.make, self.most, self.young, self.old = make, most, {}, {}

    def __call__(self, keys: list[str]) -> list[bytes]:
        found = list(map(self.young.get, keys))
        for i, known in enumerate(found):
            if known is None:
                key = keys[i]
                known = self.old.get(key)
                if known is None:
                    known = self.make(key)
                self.young[key] = found[i] = known
        if len(self.young) >= self.most:
            self.old, self.young = self.young, {}
        return found


#: White space of either library, as part of a class.
_SPACE = r"\s\pZ\x{0B}\x{85}\x{1C}-\x{1F}"
#: A byte-level pre-tokenizer always cuts between one line end and a letter, behind a letter, and before a letter that
#: doesn't follow white space or an apostrophe. More white space isn't cut: what follows decides how it is divided.
_CUTS = ((rf"([^{_SPACE}\x00]\n)(\pL)", "\\1\0\\2"), (r"(\pL)([^\pL\x00])", "\\1\0\\2"), (rf"([^\pL\x27\x00{_SPACE}])(\pL)", "\\1\0\\2"))
#: The byte-level alphabet's letter for each byte: printable ones stand for themselves, the others follow from U+0100.
_PLAIN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
_LETTERS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PLAIN)}


def _spread(flat: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of flat (of these sizes) in the order of codes, one after the other; and the size of each."""
    n = sizes[codes]
    ends = np.cumsum(n)
    shift = (np.cumsum(sizes) - sizes)[codes] - (ends - n)
    return flat[np.repeat(shift, n) + np.arange(int(ends[-1]) if len(ends) else 0)], n


class Encoder:
    """Ids of texts, equal to the tokenizers library's own for the whole text, and several times as fast.

    With a byte-level pre-tokenizer a space between two characters that aren't white space always begins a new piece,
    and so does the change from a letter to something else. Arrow cuts many texts at such spaces and numbers the
    distinct chunks, then cuts those at such changes and numbers the distinct pieces; only these reach the library's
    model, behind a bounded memo. With `added`, the library's default, texts that hold one of the tokenizer's added
    tokens go through the library's encode, which gives those tokens their ids; else such strings are ordinary text.
    """

    def __init__(self, path: str, added: bool = True):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] if added else []
        model, cut = self.tokenizer.model, self.tokenizer.pre_tokenizer.pre_tokenize_str

        tokenize, space = model.tokenize, chr(_LETTERS[32])

        def make(s: str) -> bytes:
            word = s[1:] if s[:1] == " " else s
            if word.isalpha():  # Latin letters are one piece
                if word.isascii():
                    return array("I", [t.id for t in tokenize(word if word is s else space + word)]).tobytes()
                if max(word) < "\u0250":
                    return array("I", [t.id for t in tokenize(s.encode().decode("latin-1").translate(_LETTERS))]).tobytes()
            return array("I", [t.id for p, _ in cut(s) for t in tokenize(p)]).tobytes()

        self.pieces = Memo(make)

    def _chunks(self, keys: pa.Array, spaced: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct chunks, and the number of each; spaced: which have a space before them."""
        letters = np.asarray(pc.utf8_is_alpha(keys))  # these have no change to be cut at
        mixed = keys.filter(pa.array(~letters))
        whole = pc.match_substring(mixed, "\0")
        parts = mixed
        for what, to in _CUTS:
            parts = pc.replace_substring_regex(parts, what, to)
        parts = pc.split_pattern(parts, "\0")
        if pc.any(whole).as_py():  # the separator's own character occurs: such chunks stay whole
            parts = pa.array([[k] if w else p for k, w, p in zip(mixed.to_pylist(), whole.to_pylist(), parts.to_pylist(), strict=True)], pa.large_list(pa.large_string()))
        counts = np.ones(len(keys), dtype=np.int64)
        counts[~letters] = np.asarray(pc.list_value_length(parts))
        coded = pa.concat_arrays([keys.filter(pa.array(letters)), parts.flatten()]).dictionary_encode()
        found = np.asarray(coded.indices)
        alone = np.zeros(int(counts.sum()), dtype=bool)
        alone[(np.cumsum(counts) - counts)[letters]] = True
        codes = np.empty(len(alone), dtype=np.int64)
        codes[alone], codes[~alone] = np.split(found * 2, [int(letters.sum())])
        codes[(np.cumsum(counts) - counts)[spaced]] += 1
        seen = np.zeros(2 * len(coded.dictionary), dtype=bool)
        seen[codes] = True
        used = np.flatnonzero(seen)
        codes = (np.cumsum(seen, dtype=np.int32) - 1)[codes]
        names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = self.pieces([" " + names[k >> 1] if k & 1 else names[k >> 1] for k in used.tolist()])
        sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        flat, n = _spread(np.frombuffer(b"".join(ids), dtype=np.uint32), sizes, codes)
        ends = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(counts)])]
        return flat, np.diff(ends)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts, one after the other, and the number of each text. Null: none."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        held = np.zeros(len(texts), dtype=bool)
        for token in self.added:
            held |= np.asarray(pc.match_substring(texts, token))
        if not held.any():
            return self._plain(texts)
        ids, sizes = self._plain(texts.filter(pa.array(~held)))
        runs = iter(np.split(ids, np.cumsum(sizes)[:-1]) if len(sizes) else [])
        own = (np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, dtype=np.uint32) for t in texts.filter(pa.array(held)).to_pylist())
        parts = [next(own if h else runs) for h in held]
        return np.concatenate(parts).astype(np.uint32), np.array(list(map(len, parts)), dtype=np.int64)

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not len(texts):
            return np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)
        odd = np.asarray(pc.match_substring_regex(texts, _ODD))
        plain = pc.split_pattern(texts.filter(pa.array(~odd)), " ")
        counts = np.zeros(len(texts), dtype=np.int64)
        counts[~odd] = np.asarray(pc.list_value_length(plain))
        cut = [_SAFE.split(t) for t in texts.filter(pa.array(odd)).to_pylist()]
        counts[odd] = list(map(len, cut))
        coded = pa.concat_arrays([plain.flatten(), pa.array(list(chain.from_iterable(cut)), pa.large_string())]).dictionary_encode()
        codes, keys = np.asarray(coded.indices).astype(np.int64), coded.dictionary
        if odd.any():  # back into the order of the texts
            order = np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)])
            codes = np.split(codes, np.cumsum(counts[order])[:-1])
            codes = np.concatenate([codes[i] for i in np.argsort(order, kind="stable")])
        first = np.cumsum(counts) - counts
        leading, codes[first] = np.unique(codes[first], return_inverse=True)
        codes[first] += len(keys)  # a text's first chunk has no space before it
        flat, sizes = self._chunks(pa.concat_arrays([keys, keys.take(pa.array(leading))]), np.arange(len(keys) + len(leading)) < len(keys))
        out, n = _spread(flat, sizes, codes)
        total = np.concatenate([[0], np.cumsum(n)])
        last = np.cumsum(counts)
        return out, total[last] - total[last - counts]


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, added: bool = True) -> Encoder:
    """This process's encoder for a tokenizer file."""
    if (path, added) not in _encoders:
        _encoders[path, added] = Encoder(path, added)
    return _encoders[path, added]


def _bites(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, pa.Array]]:
    """Runs of rows with so many bytes of text, or one longer text."""
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)
        lot = np.cumsum(sizes) // BITE
        cuts = [0, *(np.flatnonzero(np.diff(lot)) + 1), len(ids)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield ids[a:b].to_pylist(), texts[a:b]


def _write(folder: str, tokenizer: str, end_id: int, most: int, added: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem
        from pyspark import TaskContext

        store, root = FileSystem.from_uri(folder)
        encode, part, seq = encoder(tokenizer, added), TaskContext.get().partitionId(), 0
        docs: list = []
        held: list[np.ndarray] = []
        lengths: list[int] = []

        def flush():
            nonlocal seq, docs, held, lengths
            name = f"{root}/{part:06d}-{seq:06d}-{uuid.uuid4().hex}.swm"  # another attempt writes another file
            data = pack(np.concatenate(held), docs, np.array(lengths))
            store.create_dir(root)
            with store.open_output_stream(name) as f:
                f.write(data)
            kinds = [pa.string(), pa.int32(), pa.int32(), *[pa.int64()] * 4]
            row = {"path": [name], "part": [part], "seq": [seq], "first_id": [docs[0]], "docs": [len(docs)], "tokens": [sum(lengths)], "bytes": [len(data)]}
            docs, held, lengths, seq = [], [], [], seq + 1
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row.values(), kinds, strict=True)], names=list(row))

        total = 0
        for ids, texts in _bites(batches):
            flat, counts = encode(texts)
            ends = np.cumsum(counts)
            flat = np.insert(flat, ends, end_id).astype(np.uint32)
            counts = counts + 1
            ends, k = np.cumsum(counts), 0
            while k < len(ids):
                begin = int(ends[k] - counts[k])
                j = max(k + 1, int(np.searchsorted(ends, begin + most - total, side="right")))
                docs += ids[k:j]
                lengths += counts[k:j].tolist()
                held.append(flat[begin : int(ends[j - 1])])
                total += int(ends[j - 1]) - begin
                if j < len(ids) or total >= most:
                    yield flush()
                    total = 0
                k = j
        if docs:
            yield flush()

    return run


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        store, _ = FileSystem.from_uri(folder)
        for batch in batches:
            for path, offset in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with store.open_input_stream(path) as f:
                    matrix, docs, lengths = unpack(f.read())
                ids = matrix.decode().astype("<u4")
                ends = np.cumsum(lengths)
                crc = [zlib.crc32(ids[e - n : e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(offset + ends - lengths), pa.array(lengths), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def write_shards(docs: DataFrame, tokenizer: str, end_id: int = 0, shard_tokens: int = SHARD_TOKENS, id_col: str = "doc_id", text_col: str = "text", added: bool = True) -> tuple[str, DataFrame]:
    """Encodes every whole text (null: empty), puts end_id after it and writes shards in ascending order of the ids.

    Returns the folder and its manifest: path, part, seq, first_id, docs, tokens, bytes. Ids may be null (they come
    first) or repeat; other columns are ignored. A task that runs again writes files of other names, and only files in
    the manifest count, so a lost executor leaves nothing wrong. `tokenizer` is a path that every executor has.
    `added`: strings of its added tokens get those tokens' ids, as by the library's default.
    """
    folder = new_path(docs.sparkSession, "shards")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # a crowd of rows with one id is several ranges
    laid = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")
    kind = "path string, part int, seq int, first_id long, docs long, tokens long, bytes long"
    made = laid.mapInArrow(_write(folder, tokenizer, end_id, shard_tokens, added), kind)
    return folder, written(made, "manifest")


def read_shards(folder: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the shards of a manifest."""
    placed = prefix_sums(manifest.select("path", "first_id", "part", "seq", "tokens"), ["first_id", "part", "seq"], {"tokens": "offset"})
    return by_file(placed.select("path", "offset")).mapInArrow(_read(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_table(docs: DataFrame, tokenizer: str, end_id: int = 0, added: bool = True) -> DataFrame:
    """Writes shards and reads them back: doc_id, start (ids before it), n_tokens (with end_id), ids_crc32 (as '<u4').

    Rows with equal doc_id follow one another by a hash of their text. An empty table gives an empty result.
    """
    return read_shards(*write_shards(docs, tokenizer, end_id, added=added))
