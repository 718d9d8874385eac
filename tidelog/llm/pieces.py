"""SentencePiece BPE encoding and decoding through a table of prefixes.

The encoding of a text is unique, and so is the last token of the encoding of each of its
prefixes. ``PieceCodec`` fills that table from left to right: an automaton gives the pieces that
end at a position, and the one piece that fits is the one which is compatible with the last token
of the prefix before it. Two tokens are compatible if merging the characters of both gives just
these two. Reading the table backwards gives the ids.

No piece crosses from a non-space to a space mark, so texts are cut before runs of space marks
(and around line feeds, which no piece contains) and the parts are kept in a bounded memo.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from tidelog.llm.common import bounded

SPACE = "▁"
NORMAL, USER_DEFINED, UNUSED, BYTE = 1, 4, 5, 6  # fixed values of the model format
#: Entries of each of the memo's two generations.
MEMO = 300_000


class PieceCodec:
    """Encodes and decodes with the pieces of a BPE model: (text, score, kind) in order of id."""

    def __init__(self, pieces: list[tuple[str, float, int]], end_id: int) -> None:
        self.end_id = end_id
        self.text = [p for p, _, _ in pieces]
        self.score = {p: (s, i) for i, (p, s, k) in enumerate(pieces) if k == NORMAL}
        self.byte = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(pieces) if k == BYTE}
        self.raw = {i: bytes([b]) for b, i in self.byte.items()}
        if any(k in (USER_DEFINED, UNUSED) for _, _, k in pieces) or len(self.byte) != 256:
            raise ValueError("only models with normal pieces and all byte pieces are supported")
        if any(SPACE in p.lstrip(SPACE) for p in self.score):
            raise ValueError("a piece holds a space mark after other characters")
        lines = "" if any("\n" in p for p in self.score) else "\n"
        self.parts = re.compile(f"{SPACE}*[^{SPACE}{lines}]+|{SPACE}+" + "|\n" * bool(lines), re.S).findall
        self.right: dict[str, list] = {}
        self.left: dict[str, list] = {}
        self.matches = ahocorasick.Automaton()
        for p, (_, i) in self.score.items():
            if self._merged(p) == [p]:  # others never come out of merging
                self.matches.add_word(p, (i, len(p)))
        self.matches.make_automaton()
        self.fits: dict[int, bool] = {}
        self.young: dict[str, str] = {}
        self.old: dict[str, str] = {}
        self.changed: dict[str, str] = {}

    def _merged(self, text: str) -> list[str]:
        """Merge the characters by best score, the leftmost first among equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                found = self.score.get(parts[k] + parts[k + 1])
                if found and (best is None or found[0] > best):
                    best, at = found[0], k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _edges(self, text: str) -> None:
        """Note the parts that stand at either end of a piece while it is merged: (part, score at birth, score at death)."""
        parts, left, right = list(text), [], []
        birth = {0: math.inf, 1: math.inf}
        while len(parts) > 1:
            k = max(range(len(parts) - 1), key=lambda k: self.score.get(parts[k] + parts[k + 1], (-math.inf,))[0])
            now = self.score[parts[k] + parts[k + 1]][0]
            if k == 0:
                left.append((parts[0], birth[0], now))
                birth[0] = now
            if k == len(parts) - 2:
                right.append((parts[-1], birth[1], now))
                birth[1] = now
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        self.left[text] = [*left, (text, birth[0], -math.inf)]
        self.right[text] = [*right, (text, birth[1], -math.inf)]

    def _apart(self, left: str, right: str) -> bool:
        """True if no merge across the border comes before the merges on its two sides.

        Two parts at the border merge once both are there, unless one of them is merged away before that: on the left
        also at equal scores, as the leftmost goes first. Runs of space marks, all of one score, are merged in full.
        """
        if SPACE in left[1:] or SPACE in right[1:] or left == right == SPACE or left[:1] == right[:1] == SPACE:
            return self._merged(left + right) == [left, right]
        for text in (left, right):
            if text not in self.left:
                self._edges(text)
        for x, x_birth, x_death in self.right[left]:
            for y, y_birth, y_death in self.left[right]:
                found = self.score.get(x + y)
                if found:
                    when = min(found[0], x_birth, y_birth)
                    if when > x_death and (when > y_death or when == found[0] == y_death):
                        return False
        return True

    def _fit(self, a: int, b: int) -> bool:
        key = a << 24 | b
        known = self.fits.get(key)
        if known is None:
            known = self._apart(self.text[a], self.text[b])
            if len(self.fits) >= 1_000_000:
                self.fits.clear()
            self.fits[key] = known
        return known

    def encode_part(self, part: str) -> list[int]:
        """The ids of one part; a character that no piece holds becomes its bytes."""
        last: list[int] = [-1] * (len(part) + 1)  # -1: an unknown character, which nothing merges with
        step = [1] * (len(part) + 1)
        done, fits = 0, self.fits.get
        for end, (i, n) in self.matches.iter(part):
            if end >= done:
                before = last[end + 1 - n]
                # The last token of the prefix before must fit; at the start there is none.
                fit = before < 0 or fits(before << 24 | i)
                if fit or fit is None and self._fit(before, i):
                    done = end + 1
                    last[done], step[done] = i, n
        ids: list[int] = []
        end = len(part)
        while end:
            i = last[end]
            if i < 0:
                ids.extend([self.byte[b] for b in reversed(part[end - 1].encode())])
            else:
                ids.append(i)
            end -= step[end]
        ids.reverse()
        return ids

    def _known(self, part: str) -> str:
        """The ids of a part as text, from the memo if there. What decoding would not give back is noted."""
        found = self.old.get(part)
        if found is None:
            ids = self.encode_part(part)
            found = " ".join(map(str, ids))
            back = self._surface(ids)
            if back != part.replace(SPACE, " "):
                self.changed[part] = back
        if len(part) <= 64:
            if len(self.young) >= MEMO:
                self.old, self.young = self.young, {}
            self.young[part] = found
        return found

    def _surface(self, ids: list[int]) -> str:
        out, pending = [], b""
        for i in ids:
            if i in self.raw:
                pending += self.raw[i]
                continue
            out.append(_decoded(pending) + self.text[i])
            pending = b""
        return ("".join(out) + _decoded(pending)).replace(SPACE, " ")

    def _split(self, text: str) -> list[str]:
        return self.parts(SPACE + text.replace(" ", SPACE)) if text else []

    def encode(self, text: str) -> list[int]:
        return [i for part in self._split(text) for i in self.encode_part(part)] + [self.end_id]

    def decode(self, ids: list[int]) -> str:
        """The text of ids; the space mark that encoding puts first goes."""
        text = self._surface([i for i in ids if i != self.end_id])
        return text[1:] if text[:1] == " " and ids and self.text[ids[0]][:1] == SPACE else text

    def digest(self, text: str) -> tuple[int, str, str]:
        """(ids with the end id, SHA-256 of the decimal ids, SHA-256 of the decoded text)."""
        parts, n, ids = self._split(text), 1, hashlib.sha256()
        for k in range(0, len(parts), 65536):
            block = parts[k : k + 65536]
            found = list(map(self.young.get, block))
            if None in found:
                known = self._known
                found = [f or known(p) for f, p in zip(found, block, strict=True)]
            line = " ".join(found) + " "
            n += line.count(" ")
            ids.update(line.encode())
        ids.update(str(self.end_id).encode())
        if self.changed:  # parts that decode to something else than themselves
            back = "".join([self.changed.get(p) or p.replace(SPACE, " ") for p in parts])[1:]
        else:
            back = text.replace(SPACE, " ")
        return n, ids.hexdigest(), hashlib.sha256(back.encode()).hexdigest()


def _decoded(raw: bytes) -> str:
    return raw.decode("utf-8", "replace") if raw else ""


def read_pieces(path: str) -> tuple[list[tuple[str, float, int]], int]:
    """The pieces of a model file and the id of its end piece; checks that its rules are those above."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    norm, trained = model.normalizer_spec, model.trainer_spec
    if norm.name != "identity" or norm.precompiled_charsmap or not norm.add_dummy_prefix or norm.remove_extra_whitespaces:
        raise ValueError("only the identity normaliser with a dummy prefix is supported")
    if trained.model_type != trained.BPE or not trained.byte_fallback or trained.treat_whitespace_as_suffix:
        raise ValueError("only BPE models with byte fallback are supported")
    return [(p.piece, p.score, p.type) for p in model.pieces], trained.eos_id


_CODECS: dict[str, PieceCodec] = {}


def _codec(broadcast, key: str) -> PieceCodec:  # noqa: ANN001
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = PieceCodec(*broadcast.value)
    return _CODECS[key]


def encode_documents(docs: DataFrame, model: str, *, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode and decode each whole text. Returns doc_id, n_tokens, ids_sha256, decoded_sha256; with_ids adds ids and decoded.

    A null text counts as empty: one id, the end id. Rows with equal or null ids each give their own row. Other columns
    are not read, so their names cannot clash. An empty table gives an empty result. Only the vocabulary is broadcast.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(read_pieces(model))
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared, model)
        for batch in bounded(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n, ids, back = zip(*map(codec.digest, texts), strict=True) if texts else ((), (), ())
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                all_ids = [codec.encode(t) for t in texts]
                columns += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(map(codec.decode, all_ids), pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(doc_id, text).mapInArrow(run, schema)
