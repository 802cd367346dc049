"""SentencePiece BPE encoding by a table of last tokens, and decoding.

For a BPE whose merges are ordered by score, the encoding of every prefix of a text is unique,
and two neighbouring tokens can stand in an encoding if and only if they are what their joint
text encodes to. So it is enough to keep, for each prefix of a unit, its last token: of the
pieces that an Aho-Corasick automaton finds to end there, the one that is compatible with the
last token of the prefix before it. The ids are then read from the table from the back.

Units are what merges can't cross: no piece has a meta space behind another character, so a run
of meta spaces opens a unit, and a character of no piece is a unit (its UTF-8 bytes as byte
pieces, else the unknown id). Units repeat, so each Python worker keeps a bounded table of them.
"""

from __future__ import annotations

import gc
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .shared_store import bounded_batches

META = "▁"
#: Entries of each of the two tables of units in a worker; a full one becomes the older one, from which units
#: in use move on (this changes no result). With UNIT_LENGTH it bounds both to about 80 MB.
UNIT_TABLE = 200_000
#: Longer units aren't kept in the table.
UNIT_LENGTH = 40
#: Pairs of tokens whose compatibility a worker keeps (about 30 MB).
PAIR_TABLE = 250_000


class PieceCodec:
    """Encoder and decoder for one model file (BPE, identity normaliser, meta space before the text)."""

    def __init__(self, model_file: str):
        from sentencepiece import SentencePieceProcessor

        import ahocorasick

        model = SentencePieceProcessor(model_file=model_file)
        if model.normalize("  x ﬁ") != META * 3 + "x" + META + "ﬁ":
            raise ValueError(f"{model_file}: only an identity normaliser with a leading meta space is supported")
        size = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))]
        if any(META in self.pieces[i].lstrip(META) for i in plain):
            raise ValueError(f"{model_file}: a piece has a meta space behind another character")
        self.unk = model.unk_id()
        self.byte_ids = {int(self.pieces[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
        self.id_of = {self.pieces[i]: i for i in plain}
        self.score = {i: model.get_score(i) for i in plain}
        self.alphabet = {c for i in plain for c in self.pieces[i]}
        self.raw = [b"" if model.is_control(i) else bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(META, " ").encode() for i, p in enumerate(self.pieces)]
        if self.unk >= 0:
            self.raw[self.unk] = " ⁇ ".encode()
        self.is_byte = bytearray(model.is_byte(i) for i in range(size))
        self.text_of_id = [str(i) for i in range(size)]
        # a piece that merging doesn't reach never is a token, so the automaton leaves it out
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i in plain:
            if self.merge(self.pieces[i]) == [i]:
                automaton.add_word(self.pieces[i], i)
        automaton.make_automaton()
        self.automaton = automaton
        self.length = [len(p) for p in self.pieces]
        self.fits: dict[int, bool] = {}
        self.pair_base = size
        self.same = list(range(size))  # one object for each id, whoever holds it
        self.units: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        # a line break is a unit of its own where no piece has one; else only meta spaces part units
        apart = "" if any("\n" in self.pieces[i] for i in plain) else "\n"
        self.splitter = re.compile(f"{META}+[^{META}{apart}]*|[^{META}{apart}]+" + f"|{apart}" * bool(apart))

    def merge(self, text: str) -> list[int | str]:
        """The defining procedure for a short text: join the best pair, the leftmost of equals, until none is a piece."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.id_of.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.score[i] > best):
                    best, at = self.score[i], k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.id_of.get(p, p) for p in parts]

    def compatible(self, left: int, right: int) -> bool:
        key = left * self.pair_base + right
        found = self.fits.get(key)
        if found is None:
            found = self.merge(self.pieces[left] + self.pieces[right]) == [left, right]
            if len(self.fits) >= PAIR_TABLE:
                self.fits.clear()
            self.fits[key] = found
        return found

    def _covered(self, text: str) -> list[int]:
        """Ids of a text whose characters all are in the alphabet."""
        last, fits, length, base = [-1] * (len(text) + 1), self.fits.get, self.length, self.pair_base
        for end, token in self.automaton.iter(text):
            end += 1
            if last[end] < 0:
                if start := end - length[token]:
                    before = last[start]
                    if before < 0:
                        continue
                    fit = fits(before * base + token)
                    if not (self.compatible(before, token) if fit is None else fit):
                        continue
                last[end] = token
        ids, at = [], len(text)
        while at:
            token = last[at]
            if token < 0:
                raise ValueError(f"no encoding ends at {at} in {text!r}")
            ids.append(token)
            at -= length[token]
        return ids[::-1]

    def _unit(self, unit: str) -> tuple[int, ...]:
        found = self.older.get(unit)
        if found is not None:
            return self._keep(unit, found)
        if self.alphabet.issuperset(unit):
            return self._keep(unit, tuple(self._covered(unit)))
        ids: list[int] = []
        part = ""
        for c in unit:
            if c in self.alphabet:
                part += c
                continue
            if part:
                ids += self._covered(part)
                part = ""
            ids += [self.byte_ids[b] for b in c.encode()] if len(self.byte_ids) == 256 else [self.unk]
        if part:
            ids += self._covered(part)
        return self._keep(unit, tuple(ids))

    def _keep(self, unit: str, found: tuple[int, ...]) -> tuple[int, ...]:
        if len(unit) <= UNIT_LENGTH:
            if len(self.units) >= UNIT_TABLE:
                self.units, self.older = {}, self.units
            found = tuple(map(self.same.__getitem__, found))
            self.units[unit] = found
        return found

    def encode(self, text: str | None) -> list[int]:
        """Ids without begin or end; none for null and ""."""
        if not text:
            return []
        ids: list[int] = []
        known, extend = self.units.get, ids.extend
        for unit in self.splitter.findall(META + text.replace(" ", META)):
            extend(known(unit) or self._unit(unit))
        return ids

    def decode(self, ids: list[int]) -> str:
        """The text of ids: byte pieces as UTF-8 (bytes that aren't give U+FFFD each), less the one leading meta space."""
        if not ids:
            return ""
        raw = b"".join(map(self.raw.__getitem__, ids))
        first = next((i for i in ids if self.raw[i]), None)
        if first is not None and not self.is_byte[first] and self.pieces[first].startswith(META):
            raw = raw[1:]
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return _decode_broken(raw)


def _decode_broken(raw: bytes) -> str:
    out, at = [], 0
    while at < len(raw):
        for size in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + size].decode())
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


_codecs: dict[str, PieceCodec] = {}


def codec(model_file: str) -> PieceCodec:
    """The codec of a model file, made once in each Python worker."""
    if model_file not in _codecs:
        _codecs[model_file] = PieceCodec(model_file)
        gc.freeze()  # the tables hold no cycles: don't walk them
        gc.set_threshold(200_000, 50, 50)
    return _codecs[model_file]


def encode_decode(docs: DataFrame, model_file: str, text_col: str = "text", digests: bool = False) -> DataFrame:
    """Adds ``token_ids`` (array<int>), ``n_tokens`` and ``decoded_text`` to documents.

    Null and empty texts have no ids and decode to "". Repeated rows, null keys and any further
    columns stay as they are; a column of docs with the name of an added one is replaced. With
    ``digests`` it adds n_tokens, ids_sha256 and decoded_sha256 instead, so that long texts and
    id lists don't leave the Python workers. One narrow pass without a shuffle.
    """
    bounded_batches(docs.sparkSession)
    added = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()} if digests else {"token_ids": pa.list_(pa.int32()), "n_tokens": pa.int64(), "decoded_text": pa.string()}
    kept = [c for c in docs.columns if c not in added]
    if digests:
        kept = [c for c in kept if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_file)
        for batch in batches:
            rows: list[list] = [[], [], []]
            for value in batch.column(text_col):
                ids = c.encode(value.as_py())
                text = c.decode(ids)
                if digests:
                    done = (len(ids), hashlib.sha256(",".join(map(c.text_of_id.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
                else:
                    done = (pa.scalar(ids, pa.list_(pa.int32())), len(ids), text)
                for column, x in zip(rows, done, strict=True):
                    column.append(x)
            arrays = [pa.array([x.as_py() if isinstance(x, pa.Scalar) else x for x in column], kind) for column, kind in zip(rows, added.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in kept] + arrays, names=[*kept, *added])

    kinds = {"n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string", "token_ids": "array<int>", "decoded_text": "string"}
    types = dict(docs.dtypes)
    schema = ", ".join([f"`{c}` {types[c]}" for c in kept] + [f"{c} {kinds[c]}" for c in added])
    return docs.select(*{*kept, text_col}).mapInArrow(run, schema)
