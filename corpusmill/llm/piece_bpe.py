"""Encoding and decoding with a merge-type SentencePiece model, exactly as the library does.

Method: Aho-Corasick finds the longest piece at a place; a piece may follow
another only if merging their joined text gives just those two back; when no
piece fits, the last one is taken back and replaced by its next shorter prefix;
a bitfield remembers places from which no encoding exists. What the library
adds - the dummy blank, blanks as U+2581, bytes for unknown characters - is done
around it.

Re-merging a joined text needs only what happens beside its seam: the merges of
either piece alone are known once and for all, so the symbols left and right of the
seam are replayed in merge order, and the pieces stand unless a merge over the seam
comes first. Pieces that are no result of their own merges, or whose merges are not
made in order, are merged anew from characters instead.

No piece has U+2581 after another character, nor (in models that keep scripts
apart) a letter before anything but a letter, so no merge crosses such a place: a
text is cut there, which is exact, and memos bounded in bytes keep the words and
the stretches met.

Defined results: null is the empty text; the empty text has the end id only; a
text of any length is taken whole; a row's result depends on its text alone, so
repeated rows agree; other columns are not read; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANK = "▁"
#: Bytes, about, of each of a memo's two generations in a Python worker; longer texts than MEMO_CHARS are not kept.
MEMO_BYTES = 16 << 20
MEMO_CHARS = 48
#: Answers kept about pairs of pieces, for each Python worker.
CACHED = 1 << 18
#: Stands in place of ids' first blank where decoding does not give the stretch back.
ODD = "?"


class Vocabulary:
    """Pieces, ids and merge order of a model (the bytes of its file)."""

    def __init__(self, raw: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        model.ParseFromString(raw)
        kinds = pb.ModelProto.SentencePiece
        if model.trainer_spec.model_type != 2 or model.normalizer_spec.precompiled_charsmap:
            raise ValueError("a merge-type model with the identity normaliser is expected")
        self.pieces = [p.piece for p in model.pieces]
        self.kind = [p.type for p in model.pieces]
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type in (kinds.NORMAL, kinds.UNUSED, kinds.USER_DEFINED)}
        scores = sorted({p.score for p in model.pieces if p.piece in self.ids}, reverse=True)
        order = {s: n for n, s in enumerate(scores)}
        #: Place of a piece in merge order.
        self.rank = {p.piece: order[p.score] for p in model.pieces if p.piece in self.ids}
        self.byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        self.bytes_of = {i: b for b, i in self.byte_ids.items()}
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == kinds.UNKNOWN)
        self.control = {i for i, p in enumerate(model.pieces) if p.type == kinds.CONTROL}
        self.end = self.pieces.index("</s>")
        self.dummy_prefix = model.normalizer_spec.add_dummy_prefix
        if any(re.search(f"[^{BLANK}]{BLANK}", p) for p in self.ids):
            raise ValueError("a piece has a blank after another character")
        joined = {c for p in self.ids if len(p) > 1 for c in p if c != BLANK}
        letters = {c for c in joined if c.isalpha()}
        if any(x in letters and y not in letters for p in self.ids for x, y in zip(p, p[1:])):
            letters = joined
        one_of = lambda chars: f"[{re.escape(''.join(sorted(chars)))}]" if chars else "(?!)"
        #: Stretches that no merge leaves; characters that no merge touches stand alone.
        self.cut = re.compile(f"{BLANK}*(?:{one_of(joined - letters)}+{one_of(letters)}*|{one_of(letters)}+)|{BLANK}+|.", re.DOTALL)
        #: Does a line end stand alone?
        self.lines = "\n" not in joined
        #: Numbered texts that a stretch can be cut into: the pieces, and characters of pieces that are none themselves.
        self.texts = [*self.ids, *sorted(c for c in joined | {BLANK} if c not in self.ids)]


class _Memo(dict):
    """Ids of texts as text, a blank before each; two generations bound it."""

    def __init__(self, make: Callable[[str], str]):
        self.make, self.old, self.held = make, {}, 0

    def __missing__(self, key: str) -> str:
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        if len(key) <= MEMO_CHARS:
            if self.held >= MEMO_BYTES:
                self.old, self.held = dict(self), 0
                self.clear()
            self.held += 240 + len(key) + len(found)
            self[key] = found
        return found


class Encoder:
    """Backtracking encoder over one vocabulary."""

    def __init__(self, raw: bytes):
        self.v = Vocabulary(raw)
        texts = self.v.texts
        self.number = {t: k for k, t in enumerate(texts)}
        self.auto = ahocorasick.Automaton()
        for k, t in enumerate(texts):
            self.auto.add_word(t, k)
        self.auto.make_automaton()
        self.size = [len(t) for t in texts]
        self.before_end = [n - 1 for n in self.size]
        self.shorter = [next((self.number[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.number), -1) for t in texts]
        self.sides: dict[str, tuple[list, list] | None] = {}
        #: Answers about pairs of numbered texts, by left * count + right; the number after the last stands for the start.
        self.pairs: dict[int, bool] = {}
        self.memo, self.words = _Memo(self._as_text), _Memo(self._word)
        self.plain = [f" {self.v.ids[t]}" if t in self.v.ids else "" for t in texts]
        self.bare_end = f" {self.v.end}"

    def _merged(self, text: str) -> tuple[str, ...]:
        """Merge a short text from single characters, best score first, leftmost on ties."""
        return self._steps(list(text), 1)

    def _steps(self, parts: list[str], least: int) -> tuple[str, ...]:
        rank = self.v.rank
        while len(parts) > least:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return tuple(parts)

    def _sides(self, piece: str) -> tuple[list, list] | None:
        """(symbols at its start, symbols at its end) as merges make them, each with its rank; None unless its own merges give the piece, in order."""
        if piece in self.sides:
            return self.sides[piece]
        found = None
        if len(piece) == 1:
            found = [(piece, -1)], [(piece, -1)]
        elif (mine := self.v.rank.get(piece)) is not None:
            halves = self._steps(list(piece), 2)
            if len(halves) == 2 and halves[0] + halves[1] == piece:
                left, right = self._sides(halves[0]), self._sides(halves[1])
                if left and right and left[0][-1][1] < mine and right[1][-1][1] < mine:
                    found = [*left[0], (piece, mine)], [*right[1], (piece, mine)]
        self.sides[piece] = found if len(piece) == 1 or piece in self.v.rank else None
        return found

    def _follows(self, left: str | None, right: str) -> bool:
        """May right come straight after left (None: first)? Only if re-merging their text gives both back."""
        if left is None:
            return len(right) == 1 or self._sides(right) is not None or self._merged(right) == (right,)
        a, b = self._sides(left), self._sides(right)
        if a is None or b is None:
            return self._merged(left + right) == (left, right)
        rank, end = self.v.rank, 1 << 60
        a, b = a[1], b[0]
        i, j, last_i, last_j = 0, 0, len(a) - 1, len(b) - 1
        while True:
            over = rank.get(a[i][0] + b[j][0], end)
            next_a = a[i + 1][1] if i < last_i else end
            next_b = b[j + 1][1] if j < last_j else end
            if over < next_a and over <= next_b and over < end:
                return False
            if next_a <= next_b:
                if next_a == end:
                    return True
                i += 1
            else:
                j += 1

    def _pair(self, place: int) -> bool:
        left, right = divmod(place, len(self.v.texts) + 1)
        if len(self.pairs) >= CACHED:
            self.pairs.clear()
        self.pairs[place] = found = self._follows(self.v.texts[left] if left < len(self.v.texts) else None, self.v.texts[right])
        return found

    def _longest(self, text: str) -> list[int]:
        """Number of the longest text known that begins at each place."""
        longest = [-1] * len(text)
        before_end = self.before_end
        for end, k in self.auto.iter(text):  # by end, so a later one is longer
            longest[end - before_end[k]] = k
        return longest

    def _split(self, text: str) -> list[int]:
        """Numbers of the texts that a stretch of known characters is cut into."""
        longest = self._longest(text)
        size, shorter, pairs, count = self.size, self.shorter, self.pairs, len(self.v.texts) + 1
        failed, dead_ends = None, False
        done: list[int] = []
        at, n, base = 0, len(text), (count - 1) * count
        while at < n:
            k = longest[at]
            while True:
                while k >= 0:
                    fits = pairs.get(base + k)
                    if (self._pair(base + k) if fits is None else fits) and not (dead_ends and failed[(at + size[k]) >> 3] >> ((at + size[k]) & 7) & 1):
                        break
                    k = shorter[k]
                if k >= 0:
                    break
                if failed is None:
                    failed, dead_ends = bytearray(n // 8 + 1), True
                failed[at >> 3] |= 1 << (at & 7)
                taken = done.pop()  # single characters always fit, so the first place never fails
                at -= size[taken]
                base = (done[-1] if done else count - 1) * count
                k = shorter[taken]
            done.append(k)
            base = k * count
            at += size[k]
        return done

    def split(self, text: str) -> list[str]:
        """Pieces of a stretch."""
        return [text] if len(text) < 2 else [self.v.texts[k] for k in self._split(text)]

    def ids_of(self, stretch: str) -> list[int]:
        ids = []
        for piece in self.split(stretch):
            known = self.v.ids.get(piece)
            if known is not None:
                ids.append(known)
            elif self.v.byte_ids:
                ids += [self.v.byte_ids[b] for b in piece.encode()]
            else:
                ids.append(self.v.unknown)
        return ids

    def normalised(self, text: str) -> str:
        if not text:
            return ""
        return (BLANK if self.v.dummy_prefix else "") + text.replace(" ", BLANK)

    def encode(self, text: str) -> list[int]:
        """All ids of a text, the end id last."""
        return [int(i) for i in self._ids_text(text or "").replace(ODD, " ").split()]

    def decode(self, ids: list[int], first: bool = True) -> str:
        """Text of ids; only at the start of a text is one blank taken off."""
        out: list[str] = []
        pending = bytearray()
        for i in ids:
            if i in self.v.bytes_of:
                pending.append(self.v.bytes_of[i])
                continue
            if pending:
                out.append(_from_bytes(pending))
                pending = bytearray()
            if i in self.v.control:
                continue
            out.append(" ⁇ " if i == self.v.unknown else self.v.pieces[i])
            if first and self.v.dummy_prefix and out[-1].startswith(BLANK):
                out[-1] = out[-1][1:]
            first = False
        if pending:
            out.append(_from_bytes(pending))
        return "".join(out).replace(BLANK, " ")

    def _as_text(self, stretch: str) -> str:
        """Ids of a stretch; its decoded text is compared unless it consists of pieces that the vocabulary has as they are."""
        known = [self.number.get(stretch, -1)] if len(stretch) < 2 else self._split(stretch)
        plain = [self.plain[k] for k in known] if known[0] >= 0 else [""]
        if all(plain):
            return "".join(plain)
        ids = self.ids_of(stretch)
        same = self.decode(ids, first=False) == stretch.replace(BLANK, " ")
        return (" " if same else ODD) + " ".join(map(str, ids))

    def _word(self, word: str) -> str:
        """Ids of a blank and what follows it."""
        return "".join(map(self.memo.__getitem__, self.v.cut.findall(BLANK + word)))

    def _ids_text(self, text: str) -> str:
        """Ids of a whole text, a blank (or ODD) before each, the end id last."""
        if not text:
            return self.bare_end
        out, memo, words = [], self.memo.__getitem__, self.words.__getitem__
        first = self.v.dummy_prefix
        for line in text.split("\n") if self.v.lines else [text]:
            if out or not first and line is not text:
                out.append(memo("\n"))
            if "  " in line or BLANK in line or first and line.startswith(" "):
                # runs of blanks belong together
                out.append("".join(map(memo, self.v.cut.findall((BLANK if first else "") + line.replace(" ", BLANK)))))
            else:
                parts = line.split(" ")
                if not first:
                    out.append("".join(map(memo, self.v.cut.findall(parts[0]))))
                    del parts[0]
                out.append("".join(map(words, parts)))
            first = False
        out.append(self.bare_end)
        return "".join(out)

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """(number of ids, hash of the ids, hash of the decoded text) of a whole text."""
        return self.encoded(text)[1:]

    def encoded(self, text: str | None) -> tuple[str, int, str, str]:
        """(ids as text, number of ids, hash of the ids, hash of the decoded text) of a whole text.

        Each stretch was decoded when it was first encoded; where all gave their own
        text back, so does the whole.
        """
        text = text or ""
        ids = self._ids_text(text)
        if ODD in ids:
            ids = ids.replace(ODD, " ")
            decoded = self.decode([int(i) for i in ids.split()])
        else:
            decoded = text.replace(BLANK, " ")
            if text and not self.v.dummy_prefix and decoded.startswith(" "):
                decoded = self.decode([int(i) for i in ids.split()])
        return ids[1:], ids.count(" "), hashlib.sha256(ids[1:].encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def _from_bytes(raw: bytearray) -> str:
    """Bytes that are no character become U+FFFD, one for each byte, as the library does."""
    out, at = [], 0
    while at < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(bytes(raw[at : at + n]).decode())
                at += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


_encoders: dict[str, Encoder] = {}


def encoder(raw: bytes) -> Encoder:
    """One encoder for each model in a worker."""
    name = hashlib.sha256(raw).hexdigest()
    if name not in _encoders:
        _encoders[name] = Encoder(raw)
    return _encoders[name]


def _shared(docs: DataFrame, model_file: str):
    """The model's bytes, read where the query is planned and sent to all tasks."""
    with open(model_file, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int, end id last), decoded (text of those ids), one row for each row of docs."""

    model = _shared(docs, model_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model.value)
        for b in batches:
            ids = [enc.encode(t or "") for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([enc.decode(i) for i in ids], pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: what encode() gives, as digests."""

    model = _shared(docs, model_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model.value)
        for b in batches:
            rows = [enc.digest(t) for t in b.column(1).to_pylist()]
            yield pa.record_batch(
                [b.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def encode_with_digests(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int, end id last), n_tokens, ids_sha256, decoded_sha256, one row for each row of docs."""

    model = _shared(docs, model_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model.value)
        for b in batches:
            rows = [enc.encoded(t) for t in b.column(1).to_pylist()]
            ids = pa.array([np.array(r[0].split(" "), np.int32) for r in rows], pa.list_(pa.int32()))
            yield pa.record_batch(
                [b.column(0), ids, pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string()), pa.array([r[3] for r in rows], pa.string())],
                ["doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, ids array<int>, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
