"""One consistent form for texts that look the same in print.

A text is split at blanks into tokens, and only tokens with characters beyond
ASCII are touched. In a token characters that print nothing go, full and half
width become regular, accents are separated, and every letter that has a
look-alike in another script is replaced by its shape. The scripts that offer
all letters of a token are intersected: if Latin is left, or else the first of
the others in a fixed order, the token is spelled in that script, whether it
was mixed or wholly written in another one. Accents are then composed again.
Every kind of blank becomes a plain one. Case, accents, raised figures, tabs,
line breaks and the number of blanks stay.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.skew import join_groups
from tidemark.session import Scratch

#: Documents of one text in a block of pairs.
CHUNK = 4_096
#: Letters of other scripts and the Latin letters they look like, after the Unicode confusables.
LOOKALIKES = {
    "Cyrillic": "АA ВB СC ЕE НH ІI ЈJ КK МM ОO РP ЅS ТT ХX УY ҮY ԌG ԚQ ԜW ѴV ӀI аa сc ԁd еe һh іi јj ӏl оo рp ԛq гr ѕs ѵv ԝw хx уy",
    "Greek": "ΑA ΒB ΕE ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΧX ΥY ΖZ αa ϲc ιi ϳj νv οo ρp υu",
    "Armenian": "ԼL ՕO ՍU ՏS ցg հh յj ոn օo զq սu",
    "Cherokee": "ᎠD ᎡR ᎢT ᎥI ᎪA ᎫJ ᎬE ᎳW ᎷM ᎻH ᏀG ᏃZ ᏙV ᏚS ᏞL ᏟC ᏢP ᏦK ᏴB",
    "Lisu": "ꓐB ꓑP ꓓD ꓔT ꓖG ꓗK ꓙJ ꓚC ꓜZ ꓝF ꓠN ꓡL ꓢS ꓣR ꓦV ꓧH ꓪW ꓫX ꓬY ꓮA ꓰE ꓲI ꓳO ꓴU",
}
#: Look-alikes without a Latin letter, by their Cyrillic one, and those of Coptic.
FURTHER = {
    "Greek": "ΓГ ΠП ΦФ",
    "Coptic": "ⲄГ ⲠП ⲪФ ⲎH ⲒI ⲔK ⲘM ⲚN ⲞO ⲢP ⲤC ⲦT ⲨY ⲬX ⲟo ⲣp ⲥc",
}
_TABLE = {s: f"{LOOKALIKES.get(s, '')} {FURTHER.get(s, '')}" for s in [*LOOKALIKES, "Coptic"]}
#: letter -> shape, and script -> shape -> its letter. Of two letters of one script with one shape the first spells it.
_SHAPE = {p[0]: p[1] for pairs in _TABLE.values() for p in pairs.split()}
_SPELL = {s: {p[1]: p[0] for p in reversed(pairs.split())} for s, pairs in _TABLE.items()}
#: Of a shape: the scripts that offer it.
_OFFERS = {x: frozenset(["Latin" if x.isascii() else "Cyrillic", *(s for s in _SPELL if x in _SPELL[s])]) for x in set(_SHAPE.values())}

#: Characters that print nothing. Signs that prefix figures are format characters, but print.
_NOTHING = regex.compile(r"[\p{Default_Ignorable_Code_Point}\p{Cf}\p{Cc}--\p{Prepended_Concatenation_Mark}--[\t\n\v\f\r\x85]]", regex.V1)
_BLANK = regex.compile(r"[\p{Zs}-- ]", regex.V1)
_SPLIT = regex.compile(r"([\x00-\x20]+)")
_WORD = regex.compile(r"[\p{L}\p{M}]+")
_SCRIPTS = [*_TABLE, "Latin"]
_SCRIPT_OF = regex.compile("|".join(rf"(?P<{s}>\p{{Script={s}}})" for s in _SCRIPTS))


def _width(c: str) -> str:
    kind, _, code = unicodedata.decomposition(c).partition(" ")
    return "".join(chr(int(x, 16)) for x in code.split()) if kind in ("<wide>", "<narrow>") else c


_WIDTH = {ord(c): _width(c) for c in map(chr, [0x3000, *range(0xFF01, 0xFFEF)]) if _width(c) != c}


def scripts_of(letter: str) -> frozenset[str]:
    """The scripts in which a letter of this look can be written; empty for marks and letters of no matter."""
    shape = _SHAPE.get(letter, letter)
    if shape in _OFFERS:
        return _OFFERS[shape]
    if unicodedata.category(letter)[0] == "M":
        return frozenset()
    m = _SCRIPT_OF.match(letter)
    return frozenset([m.lastgroup if m else "Other"])


def spell(word: str) -> tuple[str, str]:
    """A word of letters and separate accents in its consistent spelling, and what it was.

    The second is ``single``, ``mixed`` for letters of more than one script, or
    ``whole`` for a word of one script that another one spells alike.
    """
    offers = [s for s in map(scripts_of, word) if s]
    resolved = frozenset.intersection(*offers) if offers else frozenset()
    written = {m.lastgroup for c in word if (m := _SCRIPT_OF.match(c))}
    if "Latin" in resolved or not resolved:
        script = "Latin"
    else:
        script = next((s for s in _TABLE if s in resolved), "Latin")
    table = _SPELL.get(script, {})
    shapes = (_SHAPE.get(c, c) for c in word)
    out = "".join(table.get(x, x) for x in shapes)
    return out, "mixed" if len(written) > 1 else "whole" if len(resolved) > 1 and "Latin" not in written else "single"


def _token(token: str) -> tuple[str, int, int]:
    """A token's form, and how many mixed and wholly confusable words it has."""
    token = _NOTHING.sub("", token).translate(_WIDTH)
    token = unicodedata.normalize("NFD", _BLANK.sub(" ", token))
    mixed = whole = 0
    parts, at = [], 0
    for m in _WORD.finditer(token):
        if m[0].isascii():
            continue
        word, kind = spell(m[0])
        mixed += kind == "mixed"
        whole += kind == "whole"
        parts += [token[at : m.start()], word]
        at = m.end()
    return unicodedata.normalize("NFC", "".join([*parts, token[at:]])), mixed, whole


class Former:
    """Forms of texts; keeps those of tokens, as most tokens recur."""

    def __init__(self, kept: int = 200_000):
        self.kept, self.forms = kept, {}

    def form(self, text: str) -> tuple[str, int, int]:
        mixed = whole = 0
        lines = text.split("\n")
        for i, line in enumerate(lines):
            if line.isascii() and not _control(line):
                continue
            parts = _SPLIT.split(line)
            for j, token in enumerate(parts):
                if token.isascii() and not _control(token):
                    continue
                got = self.forms.get(token)
                if got is None:
                    got = _token(token)
                    if len(self.forms) >= self.kept:
                        self.forms.clear()
                    if len(token) < 200:
                        self.forms[token] = got
                parts[j] = got[0]
                mixed += got[1]
                whole += got[2]
            lines[i] = "".join(parts)
        return "\n".join(lines), mixed, whole


_CONTROL = regex.compile(r"[\x00-\x08\x0e-\x1f\x7f]")


def _control(text: str) -> bool:
    return not text.isprintable() and _CONTROL.search(text) is not None


def consistent(text: str | None) -> str | None:
    """``text`` in its consistent form; null stays null, and the form of a form is itself."""
    return None if text is None else Former().form(text)[0]


def _forms(keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        former = Former()
        for batch in batches:
            forms, keys, raws, mixed, whole = [], [], [], [], []
            for text in batch.column("text"):
                s = text.as_py()
                if s is None:
                    for x in (forms, keys, raws, mixed, whole):
                        x.append(None)
                    continue
                f, m, w = former.form(s)
                raw = hashlib.blake2b(s.encode(), digest_size=16).digest()
                forms.append(f if keep_text else None)
                raws.append(raw)
                keys.append(raw if f == s else hashlib.blake2b(f.encode(), digest_size=16).digest())
                mixed.append(m)
                whole.append(w)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(forms, pa.string()),
                    pa.array(keys, pa.binary()),
                    pa.array(raws, pa.binary()),
                    pa.array(mixed, pa.int64()),
                    pa.array(whole, pa.int64()),
                ],
                names=["doc_id", "form", "form_key", "raw_key", "mixed_words", "whole_words"],
            )

    return run


def text_forms(documents: DataFrame, keep_text: bool = True) -> DataFrame:
    """Per document: ``form``, 128-bit keys of form and text, and the words of mixed script and of a wholly confusable spelling.

    Whole texts are read, each where it lies: nothing is shuffled. A null text
    has null in all columns but ``doc_id``; an empty one has an empty form.
    ``keep_text=False`` leaves ``form`` null where only the keys are needed.
    """
    schema = "doc_id bigint, form string, form_key binary, raw_key binary, mixed_words bigint, whole_words bigint"
    return documents.select("doc_id", "text").mapInArrow(_forms(keep_text), schema)


def lookalike_pairs(documents: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Pairs of documents with non-empty texts that differ as strings, but have one form.

    Texts are read once, and only keys go on. Distinct texts of a form are
    paired, so equal copies cost nothing until the pairs of texts are written
    out as pairs of documents. That is done in blocks of at most about CHUNK
    documents of either text, each a group of its own, so a text with a third
    of all documents is spread like any other. Null texts are in no pair; no
    documents give none.
    """
    scratch = scratch or Scratch(documents.sparkSession, "visual")
    keys = scratch.write("keys", text_forms(documents.filter("text <> ''"), keep_text=False).select("doc_id", "form_key", "raw_key"))
    texts = keys.groupBy("form_key", "raw_key").agg(F.count("*").alias("n"))
    several = texts.groupBy("form_key").agg(F.count("*").alias("texts")).filter("texts > 1").select("form_key")
    texts = scratch.write("texts", texts.join(several, "form_key").withColumn("lanes", F.ceil(F.col("n") / CHUNK).cast("int")))
    placed = join_groups(keys.select("doc_id", "raw_key"), texts.select("raw_key", "lanes"), ["raw_key"], texts, keys.count())
    lane = F.pmod(F.xxhash64("doc_id"), F.col("lanes")).cast("int")
    chunks = placed.groupBy("raw_key", lane.alias("lane")).agg(F.collect_set("doc_id").alias("ids"))  # about CHUNK
    chunks = scratch.write("chunks", chunks)

    def side(n: str) -> DataFrame:
        return texts.select("form_key", F.col("raw_key").alias(f"raw_{n}"), F.explode(F.sequence(F.lit(0), F.col("lanes") - 1)).alias(f"lane_{n}"))

    blocks = side("a").join(side("b"), "form_key").filter("raw_a < raw_b").drop("form_key")
    key = ["raw_a", "lane_a", "raw_b", "lane_b"]
    a = blocks.join(chunks.toDF("raw_a", "lane_a", "ids_a"), ["raw_a", "lane_a"]).select(*key, "ids_a")
    b = blocks.join(chunks.toDF("raw_b", "lane_b", "ids_b"), ["raw_b", "lane_b"]).select(*key, "ids_b")
    met = a.join(b, key).select(F.explode("ids_a").alias("a"), "ids_b").select("a", F.explode("ids_b").alias("b"))
    return met.filter("a <> b").select(F.least("a", "b").alias("doc_id_a"), F.greatest("a", "b").alias("doc_id_b"))
