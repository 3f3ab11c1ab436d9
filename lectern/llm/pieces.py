"""SentencePiece BPE encoding with a table of last tokens per prefix, and decoding.

Cutting an encoding between two of its tokens gives the encodings of both parts. So each prefix of a text has one last
token, and tokens t1..tn are an encoding exactly if all neighbours are compatible. For every end of a match of the
vocabulary's automaton, the one token that is compatible with the last token before it is stored, and the ids are read from
the end of the table backwards. Cost is linear in the text, however long its words are.

No piece of the vocabulary has a word mark after another character, so that no merge crosses the start of a word; words are
encoded one by one, and frequent ones once. A vocabulary in which that does not hold is refused.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Words that are kept with their ids, in two generations of CACHE words; longer words than LONGEST are not kept.
CACHE, LONGEST = 150_000, 64
#: Rows that are encoded together.
ROWS = 64
_WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_NONE = 1 << 40


class PieceModel:
    """The vocabulary of a BPE model file with byte fallback; `path` is a file of the sentencepiece library's format."""

    def __init__(self, content: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(content)
        norm, train = proto.normalizer_spec, proto.trainer_spec
        if train.model_type != 2 or norm.name != "identity" or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not train.byte_fallback or train.treat_whitespace_as_suffix:
            raise ValueError("a BPE model with identity normalisation, a dummy prefix and byte fallback is needed")
        self.begin, self.end = ([i for i, p in enumerate(proto.pieces) if p.piece == x][0] for x in (train.bos_piece, train.eos_piece))
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == 6}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.text = {i: p.piece for i, p in enumerate(proto.pieces) if p.type == 1}
        if any(MARK in p.lstrip(MARK) for p in self.text.values()):
            raise ValueError("a piece has a word mark inside")
        # Better scores merge first, and of equal ones the leftmost.
        ranks = {s: k for k, s in enumerate(sorted({proto.pieces[i].score for i in self.text}, reverse=True))}
        self.rank = {i: ranks[proto.pieces[i].score] for i in self.text}
        #: Merges of equal rank are ordered by place alone; pairs with such a token are tried out in full, once each.
        often = Counter(self.rank[i] for i, p in self.text.items() if len(p) > 1)
        self.tied = {i for i in self.text if often[self.rank[i]] > 1}
        self.id = {p: i for i, p in self.text.items()}
        self.halves: dict[int, tuple[int, int]] = {}
        reached = []
        for i, piece in sorted(self.text.items(), key=lambda x: self.rank[x[0]]):
            parts = self._merge(piece, piece)
            if len(piece) == 1:
                reached.append(i)
            elif len(parts) == 2 and self.id.get(parts[0] + parts[1]) == i:
                self.halves[i] = (self.id[parts[0]], self.id[parts[1]])
                reached.append(i)
        self.automaton = ahocorasick.Automaton()
        for i in reached:
            self.automaton.add_word(self.text[i], i << 16 | len(self.text[i]))
        self.automaton.make_automaton()
        self.joined = {(a, b): self.rank[i] for i in self.text for a, b in self._splits(self.text[i])}
        self.fits: dict[int, bool] = {}
        self.size = [len(p.piece) for p in proto.pieces]
        if len(self.size) > 1 << 24 or max(self.size) > 0xFFFF:
            raise ValueError("more than 16 million pieces, or one of more than 65535 characters")
        self.cache: dict[str, tuple[bytes, bytes]] = {}
        self.older: dict[str, tuple[bytes, bytes]] = {}
        self.piece_bytes = [p.piece.replace(MARK, " ").encode() if p.type == 1 else bytes([self.byte_of[i]]) if p.type == 6 else b"" for i, p in enumerate(proto.pieces)]

    def _splits(self, piece: str) -> list[tuple[int, int]]:
        return [(self.id[piece[:k]], self.id[piece[k:]]) for k in range(1, len(piece)) if piece[:k] in self.id and piece[k:] in self.id]

    def _merge(self, text: str, but: str | None = None) -> list[str]:
        """The merges of a short text's characters, without one that would give the piece `but`."""
        parts = list(text)
        while True:
            best = min(((self.rank[t], k) for k in range(len(parts) - 1) if (t := self.id.get(parts[k] + parts[k + 1])) is not None and parts[k] + parts[k + 1] != but), default=None)
            if best is None:
                return parts
            k = best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merges of both texts, side by side, leave exactly these two tokens.

        The later of the two merges is undone step by step; at each step the tokens that then touched must not have had a merge
        that comes before those undone so far (at equal rank the left one comes first).
        """
        a, b, left_limit, right_limit = left, right, _NONE, _NONE
        fine = True
        if left in self.tied or right in self.tied:
            fine = self._merge(self.text[left] + self.text[right]) == [self.text[left], self.text[right]]
            a = b = -1
        while a >= 0:
            r = self.joined.get((a, b))
            # A merge across the border would have come first if it ranks before the undone merge of the left side, or not after that of the right.
            if r is not None and r < left_limit and r <= right_limit:
                fine = False
                break
            ha, hb = self.halves.get(a), self.halves.get(b)
            ra, rb = self.rank[a] if ha else -1, self.rank[b] if hb else -1
            if not ha and not hb:
                break
            if ra > rb:
                left_limit, a = ra, ha[1]
            else:
                right_limit, b = rb, hb[0]
        if len(self.fits) > 1_000_000:
            self.fits.clear()
        self.fits[left << 24 | right] = fine
        return fine

    def word_ids(self, word: str) -> list[int]:
        """The table of last tokens of one marked word, read backwards; -1 stands after a character that no piece has."""
        last = [-1] * (len(word) + 1)
        known, compatible = self.fits.get, self.compatible
        for end, match in self.automaton.iter(word):
            end += 1
            if last[end] < 0:
                before = last[end - (match & 0xFFFF)]
                if before < 0:
                    last[end] = match >> 16
                else:
                    token = match >> 16
                    fine = known(before << 24 | token)
                    if compatible(before, token) if fine is None else fine:
                        last[end] = token
        out: list[int] = []
        size = self.size
        end = len(word)
        while end:
            token = last[end]
            if token >= 0:
                out.append(token)
                end -= size[token]
            else:
                end -= 1
                out.extend(self.bytes[b] for b in reversed(word[end].encode()))
        out.reverse()
        return out

    def decode(self, ids: list[int]) -> str:
        """Text of ids: pieces with marks as spaces, bytes as UTF-8; a space that the encoder put in front goes, control ids are nothing."""
        text = b"".join([self.piece_bytes[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text

    def _word(self, word: str) -> tuple[bytes, bytes]:
        got = self.older.get(word)
        if got is None:
            ids = self.word_ids(word)
            got = struct.pack(f"<{len(ids)}I", *ids), b"".join([self.piece_bytes[i] for i in ids])
        if len(word) <= LONGEST:
            if len(self.cache) >= CACHE:
                self.older, self.cache = self.cache, {}
            self.cache[word] = got
        return got

    def packed(self, text: str | None) -> tuple[bytes, bytes]:
        """(ids with begin and end as little-endian 32-bit integers, decoded text in UTF-8)."""
        begin, end = struct.pack("<I", self.begin), struct.pack("<I", self.end)
        if not text:
            return begin + end, b""
        words = _WORDS.findall(MARK + text.replace(" ", MARK))
        get = self.cache.get
        done = [get(w) or self._word(w) for w in words]
        back = b"".join([x[1] for x in done])
        return b"".join([begin, *[x[0] for x in done], end]), back[1:] if back.startswith(b" ") else back

    def encode(self, text: str | None) -> list[int]:
        ids = self.packed(text)[0]
        return list(struct.unpack(f"<{len(ids) // 4}I", ids))


_models: dict[str, PieceModel] = {}


def encode_pieces(docs: DataFrame, model_path: str, with_ids: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids and decoded for every row of docs(doc_id, text, ...), and the columns to carry.

    A null text counts as empty, whose ids are begin and end. Repeated rows and null ids are encoded like others. The columns to carry may not have
    the names of results; other columns are ignored. A text of any length is encoded as a whole, in memory linear in it. An empty table gives an empty one.
    """
    content = Path(model_path).read_bytes()
    shared, key = docs.sparkSession.sparkContext.broadcast(content), hashlib.sha256(content).hexdigest()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _models:
            _models[key] = PieceModel(shared.value)
        model = _models[key]
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                n, a, b, ids, texts = [], [], [], [], []
                for text in part.column(1):
                    x, back = model.packed(text.as_py())
                    n.append(len(x) // 4)
                    a.append(hashlib.sha256(x).hexdigest())
                    b.append(hashlib.sha256(back).hexdigest())
                    if with_ids:
                        ids.append(x)
                        texts.append(back.decode("utf-8", "replace"))
                columns = [part.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    ends = pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32))
                    columns += [pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32))), pa.array(texts, pa.string())]
                    names += ["ids", "decoded"]
                yield pa.record_batch([*columns, *part.columns[2:]], names=[*names, *carry])
            pa.default_memory_pool().release_unused()

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids + "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *carry).mapInArrow(encode, schema)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op4_sentencepiece_prefix_table(spark, sf_dir: str) -> DataFrame:
    return encode_pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_model())
