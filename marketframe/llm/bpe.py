"""Byte-level BPE encoding and decoding of whole texts by tree concatenation.

Ordinary texts are encoded in one piece. A long text is cut into halves, again and again, down to
segments; the segments are rows, so Spark encodes them in parallel, and their ids and piece
boundaries are concatenated pairwise up the tree. Around each join a growing window of both sides
is split anew until its first piece agrees with the left side and its last piece with the right
side; only the pieces that changed are encoded again:

* text level: the splitting pattern reads left to right and never looks behind, so pieces left of
  the window's first piece are final, and once the window ends in a piece boundary that the right
  side also has, everything after it is the same;
* inside one long unsplit piece (thousands of letters without a blank): tokens of the halves are
  joined the same way. A token list is the BPE encoding of a piece exactly when every neighbouring
  pair is, so one agreeing token on either side of the window is a proof. Shorter texts with such a piece
  are encoded by halves in the task that reads them.

The vocabulary (a ``tokenizers`` JSON file of a byte-level BPE) is a parameter and is read where
the worker runs; nothing is trained. Null text is the empty text: no ids, decoded to ''.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketframe.llm import textbytes as tb
from marketframe.llm.textbytes import small_batches

LONG_TEXT = 32768      # characters; longer texts are encoded by segments
LEAF = 8192            # characters of a segment at most
LONG_PIECE = 512       # bytes; a longer unsplit piece is encoded by halves
KNOWN_PIECES = 1 << 15 # short pieces whose ids a worker remembers, at most
#: Fixed value: the splitting pattern of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        import regex
        import tiktoken
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in shown}
        byte_of |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        ranks = {bytes(byte_of[c] for c in word): i for word, i in spec["model"]["vocab"].items()
                 if word not in self.special}
        self.core = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks,
                                      special_tokens=self.special)
        self.bytes_of = {i: word for word, i in ranks.items()}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        blank = r"\p{White_Space}"
        plain = PATTERN.replace(r"[^\s", "[^" + blank).replace(r"\s", blank).replace(r"\S", r"\P{White_Space}")
        self.split = regex.compile(plain)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.known: dict[str, list[int]] = {}              # ids of pieces met before
        self.long_run = regex.compile(rf"\S{{{LONG_PIECE}}}|\s{{{LONG_PIECE}}}")
        self.longest_mark = max([1, *map(len, self.special)])

    # ------------------------------------------------------------------ whole texts
    def encode(self, text: str, long_run: bool | None = None) -> np.ndarray:
        """Ids of a text; ``long_run`` tells whether it may hold a long unsplit piece (found out, if not
        given), which is then encoded by halves."""
        if self.long_run.search(text) if long_run is None else long_run:
            return self.encode_pieces(text).ids
        return self.core.encode_to_numpy(text, allowed_special="all").astype("<u4")

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes_of.__getitem__, np.asarray(ids).tolist())).decode("utf-8", "replace")

    # ------------------------------------------------------------------ one unsplit piece
    def piece(self, piece: str) -> list[int]:
        if piece in self.special:
            return [self.special[piece]]
        found = self.known.get(piece)
        if found is None:
            found = self._bytes(piece.encode())
            if len(piece) <= 32 and len(self.known) < KNOWN_PIECES:
                self.known[piece] = found
        return found

    def _bytes(self, raw: bytes) -> list[int]:
        if len(raw) <= LONG_PIECE:
            return self.core._core_bpe.encode_single_piece(raw) if raw else []
        half = len(raw) // 2
        return self.join_tokens(self._bytes(raw[:half]), self._bytes(raw[half:]))

    def join_tokens(self, left: list[int], right: list[int]) -> list[int]:
        width = 4
        while True:
            a, b = left[max(0, len(left) - width):], right[:width]
            window = self.core._core_bpe.encode_single_piece(b"".join(self.bytes_of[i] for i in a + b))
            left_ok = len(a) == len(left) or window[0] == a[0]
            right_ok = len(b) == len(right) or window[-1] == b[-1]
            if left_ok and right_ok:
                return left[:len(left) - len(a)] + window + right[len(b):]
            width *= 2

    def pieces(self, text: str) -> list[str]:
        """Special tokens stand alone; the pattern splits what is between them."""
        if not self.marks or not self.marks.search(text):
            return self.split.findall(text)
        return [p for part in self.marks.split(text)
                for p in ([part] if part in self.special else self.split.findall(part))]

    # ------------------------------------------------------------------ encoded segments
    def encode_pieces(self, text: str) -> "Encoded":
        found = [self.piece(p) for p in self.pieces(text)]
        return Encoded(np.array([i for ids in found for i in ids], "<u4"),
                       np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int64))

    def join(self, left: "Encoded", right: "Encoded") -> "Encoded":
        """Encoding of the concatenated text. Around the join a growing window of pieces is split anew
        until its first and last piece are those of the sides; only pieces that changed are encoded.
        The window starts so far left that a special token cut in two lies inside it whole."""
        width = 2
        while True:
            a, b = left.texts(self, len(left) - width, len(left)), right.texts(self, 0, width)
            window = self.pieces("".join(a) + "".join(b))
            free = sum(map(len, a[1:])) >= self.longest_mark or len(a) == len(left)
            left_ok = len(a) == len(left) or (free and window[0] == a[0])
            safe = sum(map(len, b[:-1])) >= self.longest_mark
            right_ok = len(b) == len(right) or (safe and window[-1] == b[-1])
            if left_ok and right_ok:
                break
            width *= 2
        same = 0                                            # pieces of the left side that stay
        while same < min(len(a), len(window)) and window[same] == a[same]:
            same += 1
        after = 0                                           # pieces of the right side that stay
        while after < min(len(b), len(window) - same) and window[-1 - after] == b[-1 - after]:
            after += 1
        middle = []
        for text in window[same:len(window) - after]:
            if a and b and text == a[-1] + b[0] and text not in self.special:
                middle.append(self.join_tokens(left.ids_of(len(left) - 1), right.ids_of(0)))
            else:
                middle.append(self.piece(text))
        keep, drop = len(left) - len(a) + same, len(b) - after
        ids = [left.ids[:left.cuts[keep]], *(np.array(m, "<u4") for m in middle), right.ids[right.cuts[drop]:]]
        sizes = np.concatenate([np.diff(left.cuts[:keep + 1]), [len(m) for m in middle], np.diff(right.cuts[drop:])])
        return Encoded(np.concatenate(ids), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64))

    def tree(self, parts: list["Encoded"]) -> "Encoded":
        """Joins the parts pairwise, level by level."""
        while len(parts) > 1:
            parts = [self.join(parts[i], parts[i + 1]) if i + 1 < len(parts) else parts[i]
                     for i in range(0, len(parts), 2)]
        return parts[0] if parts else Encoded(np.zeros(0, "<u4"), np.zeros(1, np.int64))


class Encoded:
    """Ids of a text and where its pieces begin among them."""

    def __init__(self, ids: np.ndarray, cuts: np.ndarray):
        self.ids, self.cuts = ids, cuts

    def __len__(self) -> int:
        return len(self.cuts) - 1

    def ids_of(self, k: int) -> list[int]:
        return self.ids[self.cuts[k]:self.cuts[k + 1]].tolist()

    def texts(self, codec: Codec, start: int, stop: int) -> list[str]:
        """Pieces ``start`` to ``stop`` as text; a piece is whole characters."""
        return [b"".join(codec.bytes_of[i] for i in self.ids_of(k)).decode()
                for k in range(max(0, start), min(stop, len(self)))]


def long_runs(column) -> np.ndarray:
    """Texts of an Arrow column with ``LONG_PIECE`` bytes or more without an ASCII blank, or of blanks
    alone; other texts hold no long unsplit piece."""
    data, off = tb.text_bytes(column)
    out = np.zeros(len(off) - 1, bool)
    blank = np.isin(data, np.frombuffer(b" \t\n\v\f\r", np.uint8))
    for d in (data, np.where(blank, np.uint8(1), np.uint8(32))):
        starts, ends, first = tb.word_bounds(d, off)
        out[tb.owner(first, np.flatnonzero(ends - starts >= LONG_PIECE))] = True
    return out


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def _row(doc, ids: np.ndarray, decoded: str | None, with_ids: bool):
    return {"doc_id": doc, "n_tokens": len(ids), "ids_sha256": hashlib.sha256(ids.tobytes()).hexdigest(),
            "decoded_sha256": hashlib.sha256(decoded.encode()).hexdigest()} | (
        {"ids": ids.astype(np.int64).tolist(), "decoded": decoded} if with_ids else {})


def _schema(id_type: str, with_ids: bool) -> str:
    s = f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return s + ", ids array<int>, decoded string" if with_ids else s


def bpe_round_trip(docs: DataFrame, vocabulary: str | None = None, with_ids: bool = False,
                   long_text: int = LONG_TEXT, leaf: int = LEAF) -> DataFrame:
    """Encodes and decodes ``docs(doc_id, text)``: one row per input row (repeated rows stay
    repeated) with the token count and SHA-256 digests of the ids (little-endian uint32) and of
    the decoded text; ``with_ids`` adds the ids and the decoded text. Null text gives no ids and
    the empty text; other columns are ignored; an empty table gives an empty result."""
    path = vocabulary or default_vocabulary()
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = small_batches(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    schema = _schema(kind, with_ids)

    def short(batches):
        import pyarrow as pa
        c = codec(path)
        for batch in batches:
            rows = []
            for doc, text, long_run in zip(batch.column("doc_id").to_pylist(), batch.column("text"),
                                           long_runs(batch.column("text")).tolist()):
                ids = c.encode(text.as_py(), long_run)
                rows.append(_row(doc, ids, c.decode(ids), with_ids))
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=target)

    def cut(batches):
        """Rows of segments: 2^depth parts of equal length, each at most ``leaf`` characters."""
        import pyarrow as pa
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                text = text.as_py()
                parts = 1 << max(0, -(-len(text) // leaf) - 1).bit_length()
                step = -(-len(text) // parts)
                mark = hashlib.sha256(text.encode()).hexdigest()
                rows = [{"doc_id": doc, "mark": mark, "pos": i, "segment": text[i * step:(i + 1) * step]}
                        for i in range(parts)]
                yield pa.RecordBatch.from_pylist(rows, schema=cut_schema)

    def encode_segments(batches):
        """Ids of a segment and the sizes of its pieces."""
        import pyarrow as pa
        c = codec(path)
        for batch in batches:
            found = [c.encode_pieces(t) for t in batch.column("segment").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in ("doc_id", "mark", "pos")),
                 pa.array([e.ids.tobytes() for e in found], pa.binary()),
                 pa.array([np.diff(e.cuts).astype("<u4").tobytes() for e in found], pa.binary())],
                ["doc_id", "mark", "pos", "ids", "sizes"])

    def concatenate(table):
        import pyarrow as pa
        c = codec(path)
        copies = table.column("pos").to_pylist().count(0)      # repeated rows bring every part again
        table = table.sort_by("pos")
        parts = [Encoded(np.frombuffer(i, "<u4"), np.concatenate([[0], np.cumsum(np.frombuffer(n, "<u4"))]).astype(np.int64))
                 for i, n in zip(table.column("ids").to_pylist()[::copies], table.column("sizes").to_pylist()[::copies])]
        ids = c.tree(parts).ids
        row = _row(table.column("doc_id")[0].as_py(), ids, c.decode(ids), with_ids)
        return pa.Table.from_pylist([row] * copies, schema=target)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string
    target = to_arrow_schema(_parse_datatype_string(schema))
    cut_schema = to_arrow_schema(_parse_datatype_string(
        f"doc_id {kind}, mark string, pos int, segment string"))

    size = F.char_length("text")
    direct = docs.where(size <= long_text).mapInArrow(short, schema)
    segments = docs.where(size > long_text).mapInArrow(cut, f"doc_id {kind}, mark string, pos int, segment string")
    encoded = segments.repartition("doc_id", "mark", "pos").mapInArrow(
        encode_segments, f"doc_id {kind}, mark string, pos int, ids binary, sizes binary")
    joined = encoded.groupBy("doc_id", "mark").applyInArrow(concatenate, schema)
    return direct.unionByName(joined)
