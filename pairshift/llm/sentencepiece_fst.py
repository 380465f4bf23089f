"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Compiled from the model file (a parameter): a normaliser (one arc per character, found by probing the model, plus the
word mark in front), a trie of the pieces, and byte fallback (a character that no piece spells is the pieces of its
UTF-8 bytes). Composed with an input they give a lattice: states are places in the normalised text together with the
last piece. Its arcs are weighted in the tropical semiring. For a unigram model an arc costs the negative score of
its piece. For a BPE model the last factor of the composition accepts pairs of pieces: an arc costs 0 when the merges
of the two pieces' characters give back exactly these two, and infinity otherwise. A sequence is what the merges
make of a text exactly when all its neighbours are such pairs, so the shortest path is the model's own encoding, and
one piece per place is enough to remember.

Where no piece joins two characters (a word mark after another sign, a line feed), the lattice falls into chunks; the
best path of a chunk is remembered in a bounded table. Decoding runs the inverse: pieces to bytes, word marks to
spaces, the leading mark dropped; bytes that are no UTF-8 become U+FFFD.

Edge cases: null and empty texts have no ids; repeated rows are encoded one by one; a text that holds the word mark
itself decodes to a space there (``round_trip`` false); texts are encoded whole in any length; an empty table gives an
empty table; other columns do not matter. A normaliser that drops or joins white space is refused, and one that maps several characters jointly when
the probes (`JOINT`, and every character's canonical decomposition) show it.
"""

from __future__ import annotations

import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairshift.llm.common import whole_text

MARK = "▁"
KNOWN_CHUNKS = 600_000
KNOWN_PAIRS = 500_000
ROWS = 256
#: What normalisers join or reorder: accents, Hangul, kana, Indic vowels, marks out of order, line ends, letters after a space.
JOINT = ("e\u0301", "E\u0300\u0323", "q\u0307\u0323", "\u1112\u1161\u11ab", "\uac00\u11a8", "\u30ab\u3099", "\uff76\uff9e", "\u09c7\u09be", "\u0627\u0653",
         "\u05d0\u05b7", "\r\n", "a\t b", "\u03a3 \u03c3\u03c2", "a\u00ad\u200db", "\u212b\u0301")

_transducers: dict[tuple[str, str], Transducer] = {}


class Transducer:
    """Normaliser, pieces, byte fallback and, for BPE, the acceptor of pairs."""

    def __init__(self, model: str, kind: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=model)
        m, n = self.model, self.model.get_piece_size()
        self.kind = kind
        self.pieces = [m.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in plain}
        self.scores = {self.pieces[i]: m.get_score(i) for i in plain}
        self.byte_ids = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if not all(m.is_byte(i) for i in self.byte_ids):
            raise ValueError("the model has no byte fallback")
        if any(MARK in p.lstrip(MARK) for p in self.ids) or any("\n" in p for p in self.ids):
            raise ValueError("pieces that join words or lines")
        if m.normalize("a  b ") != f"{MARK}a{MARK}{MARK}b{MARK}":
            raise ValueError("a normaliser that changes white space or adds no word mark")
        self.chars: dict[str, str] = {" ": MARK}
        for probe in self._joint():
            if m.normalize(f"x{probe}x") != self.normalise(f"x{probe}x"):
                raise ValueError(f"a normaliser that changes several characters jointly: {probe!r}")
        self.trie: dict = {}  # character -> (children, the id of the piece that ends here, or -1)
        for piece, i in self.ids.items():
            if kind == "unigram" or self.merged(piece) == [piece]:  # merges reach no other piece
                children = self.trie
                for c in piece[:-1]:
                    children = children.setdefault(c, ({}, -1))[0]
                children[piece[-1]] = (children.get(piece[-1], ({}, -1))[0], i)
        self.output = [b"" if m.is_control(i) or m.is_unknown(i) else p.replace(MARK, " ").encode() for i, p in enumerate(self.pieces)]
        for b, i in enumerate(self.byte_ids):
            self.output[i] = bytes([b])
        # between a letter and one of these signs no piece goes on, so a chunk may end there too
        letter = re.compile(r"[^\W\d_]")
        stops = re.escape("".join(c for c in ".,;:!?|" if not any(p[i] == c and letter.match(p[i - 1]) for p in self.ids for i in range(1, len(p)))))
        word = rf"|{MARK}*[^\W\d_]++(?=[{stops}])" if stops else ""
        self.chunk = re.compile(rf"\n{word}|{MARK}*[^{MARK}\n]+|{MARK}+")
        self.known: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}
        self.costs = {i: self.scores[p] for p, i in self.ids.items()}
        self.fallback = 0.0 if kind == "bpe" else 10.0 - min(self.costs.values())

    @staticmethod
    def _joint() -> Iterator[str]:
        """Probes of joint mappings: ``JOINT`` and the canonical decomposition of every character that has one."""
        yield from JOINT
        for c in map(chr, range(0xA0, 0x30000)):
            if 0xD800 <= ord(c) < 0xE000:
                continue
            parts = unicodedata.normalize("NFD", c)
            if len(parts) > 1:
                yield parts

    def normalise(self, text: str) -> str:
        """The text's image under the character arcs, after one word mark."""
        if not text:
            return ""
        new = set(text).difference(self.chars)
        for c in new:
            self.chars[c] = self.model.normalize(f"x{c}x")[len(MARK) + 1 : -1]
        changed = {c: self.chars[c] for c in set(text) if self.chars[c] != c}
        if set(changed) <= {" "}:
            return MARK + text.replace(" ", MARK)
        return MARK + text.translate({ord(c): out for c, out in changed.items()})

    def merged(self, text: str) -> list[str]:
        """What the merges make of a short text: best score first, then leftmost."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.scores.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def accepts(self, left: int, right: int) -> bool:
        """Whether the merges of two neighbours' characters give back these two."""
        if len(self.pairs) >= KNOWN_PAIRS:
            self.pairs.clear()
        two = [self.pieces[left], self.pieces[right]]
        known = self.pairs[left << 32 | right] = self.merged(two[0] + two[1]) == two
        return known

    def only(self, text: str) -> list[int] | None:
        """The one path of cost 0 of a BPE model, longest pieces first; none for characters that bytes spell.

        At most one path of fitting pairs reaches a place, so a place is left for good once its arcs are tried, and
        the arcs not on the path are looked at only where a longer piece led nowhere.
        """
        if not all(map(self.ids.__contains__, text)):
            return None
        n, pairs, trie, reached, path, before, i = len(text), self.pairs, self.trie, set(), [], -1, 0
        while True:
            arcs, children, j = [], trie, i
            while j < n and children and (node := children.get(text[j])) is not None:
                children, piece = node
                j += 1
                if piece >= 0:
                    arcs.append((j, piece))
            while True:
                while arcs:
                    j, piece = arcs.pop()
                    if j in reached:
                        continue
                    if before < 0 or ((fits := pairs.get(before << 32 | piece)) is None and self.accepts(before, piece)) or fits:
                        break
                else:
                    if not path:
                        return None
                    arcs, before = path.pop()[1:]
                    continue
                break
            reached.add(j)
            path.append((piece, arcs, before))
            if j == n:
                return [step[0] for step in path]
            i, before = j, piece

    def shortest(self, text: str) -> list[int]:
        """Ids on the shortest path through the lattice of one chunk; -1 as last piece: none, or one spelt in bytes."""
        n, inf, bpe, pairs = len(text), float("inf"), self.kind == "bpe", self.pairs
        cost, back, last = [inf] * (n + 1), [None] * (n + 1), [-1] * (n + 1)
        cost[0] = 0.0
        for i in range(n):
            here, before = cost[i], last[i]
            if here == inf:
                continue
            c = text[i]
            if c not in self.ids and here + self.fallback < cost[i + 1]:
                cost[i + 1], back[i + 1], last[i + 1] = here + self.fallback, (i, [self.byte_ids[b] for b in c.encode()]), -1
            node, j = self.trie.get(c), i + 1
            while node is not None:
                children, piece = node
                if piece >= 0:
                    if not bpe:
                        w = here - self.costs[piece]
                    elif before < 0:
                        w = here
                    else:
                        if (fits := pairs.get(before << 32 | piece)) is None:
                            fits = self.accepts(before, piece)
                        w = here if fits else inf
                    if w < cost[j]:
                        cost[j], back[j], last[j] = w, (i, [piece]), piece
                if j == n or not children:
                    break
                node = children.get(text[j])
                j += 1
        path, at = [], n
        while at:
            if back[at] is None:
                raise ValueError("no path: the pairs of this model do not describe its merges")
            at, ids = back[at]
            path.append(ids)
        return [i for ids in reversed(path) for i in ids]

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        chunks = self.chunk.findall(self.normalise(text))
        found = list(map(self.known.get, chunks))
        if None in found:
            missing = [i for i, ids in enumerate(found) if ids is None]
            new = {chunks[i] for i in missing}
            if len(self.known) + len(new) > KNOWN_CHUNKS:
                self.known.clear()
            for c in new:
                ids = self.only(c) if self.kind == "bpe" else None
                ids = self.shortest(c) if ids is None else ids
                self.known[c] = struct.pack(f"<{len(ids)}I", *ids)
            for i in missing:
                found[i] = self.known[chunks[i]]
        return b"".join(found)

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.output.__getitem__, ids)).decode("utf-8", errors="replace")
        return text[1:] if text.startswith(" ") else text


def transducer(model: str, kind: str) -> Transducer:
    """One transducer per worker process and model."""
    if (model, kind) not in _transducers:
        _transducers[model, kind] = Transducer(model, kind)
    return _transducers[model, kind]


def encoded(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", kind: str = "bpe", with_ids: bool = False) -> DataFrame:
    """Per row: the id column, ``n_ids``, ``ids_crc32``, ``decoded_sha256``, ``round_trip``; with ``with_ids`` also ``ids``."""
    out = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_ids", T.LongType()), T.StructField("ids_crc32", T.LongType()),
                        T.StructField("decoded_sha256", T.StringType()), T.StructField("round_trip", T.BooleanType())])
    if with_ids:
        out = out.add("ids", T.ArrayType(T.LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(model, kind)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                b = batch.slice(start, ROWS)
                n, crc, sha, same, kept = [], [], [], [], []
                for text in b.column("body").to_pylist():
                    raw = t.encode(text)
                    ids = np.frombuffer(raw, dtype="<u4").tolist()
                    back = t.decode(ids)
                    n.append(len(ids))
                    crc.append(zlib.crc32(raw))
                    sha.append(sha256(back.encode()).hexdigest())
                    same.append(back == text)
                    if with_ids:
                        kept.append(ids)
                columns = [b.column("id"), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(sha, pa.string()), pa.array(same, pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(kept, pa.list_(pa.int64()))] if with_ids else []), names=out.names)

    return docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("body")).mapInArrow(run, out)


def decoded(rows: DataFrame, model: str, ids_col: str = "ids", out_col: str = "text", kind: str = "bpe") -> DataFrame:
    """``rows`` with the text of their id arrays; a null array gives null."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(model, kind)
        for b in batches:
            texts = [None if ids is None else t.decode(ids) for ids in b.column(ids_col).to_pylist()]
            yield b.append_column(out_col, pa.array(texts, pa.string()))

    if out_col in rows.columns:
        raise ValueError(f"there is a column {out_col} already")
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(out_col, T.StringType())]))
