"""Entity, attribute, value rows reshaped into one typed row per entity.

Values are read once per distinct spelling in a batch, the latest readable one
of an entity and attribute is kept before anything is shuffled, and entities
are then hash-bucketed. In a bucket entity and attribute are dictionary-encoded
and the values scattered into one numpy array per type by row and column.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import date
from decimal import Decimal, InvalidOperation, localcontext

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What says nothing, and how truth is written.
SILENT = {"", "n/a", "null", "none", "unknown", "-", "?"}
TRUE = {"true", "t", "yes", "y", "on", "1"}
FALSE = {"false", "f", "no", "n", "off", "0"}
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]

_NUMBER = re.compile(r"([+-]?)(\d+|\d{1,3}(?:,\d{3})+)?(?:\.(\d*))?(?:[eE]([+-]?\d{1,4}))?", re.ASCII)
_TIME = r"(?:(?:\s*[Tt]\s*|\s+|,\s*)(?:at\s+)?\d{1,2}(?::\d{2}(?::\d{2}(?:[.,]\d+)?)?)?\s*(?:[AaPp]\.?[Mm]\.?)?\s*(?:Z|z|UTC|GMT|[+-]\d{2}:?(?:\d{2})?)?)?"
_DAY = r"(\d{1,2})(?:st|nd|rd|th)?"
_WEEKDAY = r"(?:(?:mon|tue|tues|wed|thu|thur|thurs|fri|sat|sun)[a-z]*\.?,?\s+)?"
_YMD = re.compile(r"(\d{4})([-/.])(\d{1,2})\2(\d{1,2})" + _TIME, re.ASCII)
_COMPACT = re.compile(r"(\d{4})(\d{2})(\d{2})" + r"(?:[Tt ]?\d{4}(?:\d{2})?Z?|" + _TIME + ")", re.ASCII)
_NUMERIC = re.compile(r"(\d{1,2})([-/.])(\d{1,2})\2(\d{4})" + _TIME, re.ASCII)
_DAY_MONTH = re.compile(_WEEKDAY + _DAY + r"(?:\s+of)?[\s\-./,]+([a-z]{3,9})\.?[\s\-./,]+(\d{4})" + _TIME, re.ASCII | re.IGNORECASE)
_MONTH_DAY = re.compile(_WEEKDAY + r"([a-z]{3,9})\.?[\s\-./]+" + _DAY + r"[\s\-./,]+(\d{4})" + _TIME, re.ASCII | re.IGNORECASE)
_YEAR_MONTH = re.compile(r"(\d{4})[\s\-./,]+([a-z]{3,9})\.?[\s\-./,]+" + _DAY + _TIME, re.ASCII | re.IGNORECASE)


def _month(name: str) -> int | None:
    name = name.lower()
    if name == "sept":
        return 9
    hits = [i for i, m in enumerate(MONTHS, 1) if m == name or m[:3] == name]
    return hits[0] if hits else None


def _day(year: int, month: int | None, day: int) -> str | None:
    try:
        return date(year, month or 0, day).isoformat()
    except ValueError:
        return None


def read_date(text: str) -> str | None:
    """``yyyy-MM-dd`` if ``text`` names one calendar day with a four-figure year, else None.

    Day and month in figures with the year last are read only where one order
    gives a day, or both give the same.
    """
    if m := _YMD.fullmatch(text):
        return _day(int(m[1]), int(m[3]), int(m[4]))
    if m := _COMPACT.fullmatch(text):
        return _day(int(m[1]), int(m[2]), int(m[3]))
    if m := _NUMERIC.fullmatch(text):
        found = {d for a, b in ((m[1], m[3]), (m[3], m[1])) if (d := _day(int(m[4]), int(a), int(b)))}
        return found.pop() if len(found) == 1 else None
    if m := _DAY_MONTH.fullmatch(text):
        return _day(int(m[3]), _month(m[2]), int(m[1]))
    if m := _MONTH_DAY.fullmatch(text):
        return _day(int(m[3]), _month(m[1]), int(m[2]))
    if m := _YEAR_MONTH.fullmatch(text):
        return _day(int(m[1]), _month(m[2]), int(m[3]))
    return None


def _decimal(text: str) -> Decimal | None:
    m = _NUMBER.fullmatch(text)
    if not m or not (m[2] or m[3]):
        return None
    try:
        return Decimal(m[1] + (m[2] or "0").replace(",", "") + "." + (m[3] or "0") + ("E" + m[4] if m[4] else ""))
    except InvalidOperation:
        return None


def read_integer(text: str) -> str | None:
    """Plain figures, or None. Separators, a plus sign, leading zeros and a fraction of zeros are read.

    Exponents aren't an integer's form. Values beyond 64 bits aren't readable.
    """
    m = _NUMBER.fullmatch(text)
    if not m or not m[2] or m[4] or (m[3] or "").strip("0"):
        return None
    value = int(m[1] + m[2].replace(",", ""))
    return str(value) if -(2**63) <= value < 2**63 else None


def read_decimal(text: str) -> str | None:
    """Two decimals without separators, or None. Further decimals are rounded half up.

    Values that don't fit 38 figures aren't readable.
    """
    value = _decimal(text)
    if value is None or (value and value.adjusted() > 35):
        return None
    if value and value.adjusted() < -40:
        value = Decimal(0)
    with localcontext() as ctx:
        ctx.prec = 80
        out = value.quantize(Decimal("0.01"), rounding="ROUND_HALF_UP")
    return "0.00" if not out else f"{out:f}"


def read_boolean(text: str) -> str | None:
    low = text.lower()
    return "true" if low in TRUE else "false" if low in FALSE else None


READERS = {"text": lambda s: s, "integer": read_integer, "decimal": read_decimal, "date": read_date, "boolean": read_boolean}
ARROW = {"text": pa.string(), "integer": pa.int64(), "decimal": pa.decimal128(38, 2), "date": pa.date32(), "boolean": pa.bool_()}
SPARK = {"text": "string", "integer": "bigint", "decimal": "decimal(38,2)", "date": "date", "boolean": "boolean"}


def attribute_key(name: str) -> str:
    """``name`` without regard to case and to all that isn't a letter or figure."""
    return "".join(c for c in name.casefold() if c.isalnum())


def _latest(columns: tuple[str, str, str, str, str], catalogue: list[tuple[str, str]]):
    """For one task: batches of raw rows to the latest cell per entity and attribute of each batch."""
    keys = {attribute_key(a): i for i, (a, _) in enumerate(catalogue)}
    readers = [READERS[t] for _, t in catalogue]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entity, attribute, value, at, tie = (batch.column(batch.schema.get_field_index(c)) for c in columns)
            ent = entity.dictionary_encode()
            names = [s.strip() or None if s is not None else None for s in ent.dictionary.to_pylist()]
            att = attribute.dictionary_encode()
            where = np.array([keys.get(attribute_key(a), -1) if a is not None else -1 for a in att.dictionary.to_pylist()] + [-1])
            col = where[pc.fill_null(att.indices, len(where) - 1).to_numpy(zero_copy_only=False)]
            val = value.dictionary_encode()
            raw = [s.strip() if s is not None else "" for s in val.dictionary.to_pylist()] + [""]
            vix = pc.fill_null(val.indices, len(raw) - 1).to_numpy(zero_copy_only=False)
            eix = pc.fill_null(ent.indices, len(names)).to_numpy(zero_copy_only=False)
            known = np.array([n is not None for n in names] + [False])
            ok = (col >= 0) & known[eix]
            cells: dict[tuple[int, int], str | None] = {}
            pair = col.astype(np.int64) * len(raw) + vix
            uniq, inv = np.unique(pair, return_inverse=True)
            out = np.empty(len(uniq), dtype=object)
            for i, p in enumerate(uniq.tolist()):
                c, v = divmod(p, len(raw))
                if c >= 0:
                    s = raw[v]
                    out[i] = None if s.lower() in SILENT else readers[c](s)
            cell = out[inv]
            ok &= np.array([x is not None for x in out], dtype=bool)[inv] if len(out) else ok
            rows = np.flatnonzero(ok)
            # trimmed names of one entity may differ before trimming: encode again
            order_of: dict[str, int] = {}
            code = np.array([order_of.setdefault(n, len(order_of)) if n is not None else -1 for n in names] + [-1])[eix[rows]]
            when = pc.fill_null(pc.cast(at, pa.int64()), np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)[rows]
            ties = pc.fill_null(pc.cast(tie, pa.int64()), np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)[rows]
            keep = np.lexsort((ties, when, col[rows], code))
            g = code[keep].astype(np.int64) * len(catalogue) + col[rows][keep]
            last = keep[np.append(g[1:] != g[:-1], True)] if len(g) else keep
            pick = rows[last]
            entities = list(order_of)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([entities[i] for i in code[last]], pa.string()),
                    pa.array(col[pick].astype(np.int32)),
                    pa.array(cell[pick].tolist(), pa.string()),
                    pa.array(when[last]),
                    pa.array(ties[last]),
                ],
                names=["entity", "att", "cell", "at", "tie"],
            )

    return run


#: A decimal of 38 figures as it lies in memory.
_WIDE = np.dtype([("low", "<i8"), ("high", "<i8")])


def _typed(cell: pa.Array, kind: str) -> np.ndarray:
    """Cells written as text, none null, as one array of their type."""
    if kind == "boolean":
        return pc.equal(cell, "true").to_numpy(zero_copy_only=False)
    values = pc.cast(cell, ARROW[kind])
    if kind == "decimal":
        return np.frombuffer(values.buffers()[1], dtype=_WIDE)[values.offset : values.offset + len(values)] if len(values) else np.empty(0, dtype=_WIDE)
    return (pc.cast(values, pa.int32()) if kind == "date" else values).to_numpy(zero_copy_only=False)


def _column(values: np.ndarray, empty: np.ndarray, kind: str, cell: pa.Array) -> pa.Array:
    """One column of a typed grid; texts are the places of their cells."""
    if kind == "text":
        return cell.take(pa.array(values, mask=empty))
    if kind == "decimal":
        there = np.packbits(~empty, bitorder="little")
        return pa.Array.from_buffers(ARROW[kind], len(values), [pa.py_buffer(there), pa.py_buffer(np.ascontiguousarray(values))])
    return pa.array(values, pa.int32(), mask=empty).cast(pa.date32()) if kind == "date" else pa.array(values, ARROW[kind], mask=empty)


def _scatter(catalogue: list[tuple[str, str]], subject: str, flush: int):
    """For one bucket, sorted by entity: typed arrays filled by row and column, emitted as Arrow tables."""
    types = sorted({t for _, t in catalogue})
    slot = {t: [i for i, (_, x) in enumerate(catalogue) if x == t] for t in types}
    within = np.zeros(max(1, len(catalogue)), dtype=np.int64)
    kind = np.zeros(max(1, len(catalogue)), dtype=np.int64)
    for k, t in enumerate(types):
        for j, i in enumerate(slot[t]):
            within[i], kind[i] = j, k

    def emit(entity: pa.Array, row: np.ndarray, att: np.ndarray, cell: pa.Array) -> pa.RecordBatch:
        columns: list = [None] * len(catalogue)
        for k, t in enumerate(types):
            mine = np.flatnonzero(kind[att] == k)
            at = within[att[mine]], row[mine]
            empty = np.ones((len(slot[t]), len(entity)), dtype=bool)
            empty[at] = False
            values = mine if t == "text" else _typed(cell.take(pa.array(mine)), t)
            grid = np.zeros(empty.shape, dtype=values.dtype)
            grid[at] = values
            for j, i in enumerate(slot[t]):
                columns[i] = _column(grid[j], empty[j], t, cell)
        return pa.RecordBatch.from_arrays([entity, *columns], names=[subject, *(a for a, _ in catalogue)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if held.num_rows < flush:
                continue
            entities = held.column("entity").to_numpy(zero_copy_only=False)
            cut = int(np.argmax(entities == entities[-1]))  # the last entity may go on in the next batch
            if cut:
                yield pack(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield pack(held)

    def pack(table: pa.Table) -> pa.RecordBatch:
        ent = table.column("entity").combine_chunks().dictionary_encode()
        return emit(ent.dictionary, ent.indices.to_numpy(zero_copy_only=False), table.column("att").to_numpy(), table.column("cell").combine_chunks())

    return run


def _catalogue(catalog: DataFrame) -> list[tuple[str, str]]:
    rows = catalog.select("attribute", "value_type").filter("attribute is not null and value_type is not null").distinct().collect()
    seen: dict[str, tuple[str, str]] = {}
    for a, t in sorted((r[0], r[1]) for r in rows):
        if t not in READERS:
            raise ValueError(f"unknown value_type {t!r} of {a!r}")
        seen.setdefault(attribute_key(a), (a, t))
    return list(seen.values())


def _cells(facts: DataFrame, catalogue: list[tuple[str, str]]) -> DataFrame:
    cols = ("subject", "attribute", "value", "asserted_at", "fact_id")
    raw = facts.select(*cols)
    local = raw.mapInArrow(_latest(cols, catalogue), "entity string, att int, cell string, at bigint, tie bigint")
    best = F.max_by("cell", F.struct("at", "tie", "cell"))  # combined again before the shuffle
    return local.groupBy("entity", "att").agg(best.alias("cell"))


def wide_table(facts: DataFrame, catalog: DataFrame, flush: int = 200_000) -> DataFrame:
    """One row per subject with at least one cell, one typed column per attribute of ``catalog``.

    Subjects are trimmed; null or blank is no subject. Attributes match without
    regard to case and to all that isn't a letter or figure. Of the readable
    values of a cell the latest ``asserted_at`` wins (null before all others,
    equal times by the larger ``fact_id``). Repeated rows change nothing.
    Unreadable values give no cell. An empty table gives no rows. The catalogue
    has one row per output column, so its size is that of the schema.
    """
    catalogue = _catalogue(catalog)
    schema = ", ".join(["`subject` string", *(f"`{a}` {SPARK[t]}" for a, t in catalogue)])
    bucketed = _cells(facts, catalogue).repartition("entity").sortWithinPartitions("entity")
    return bucketed.mapInArrow(_scatter(catalogue, "subject", flush), schema)


def wide_cells(facts: DataFrame, catalog: DataFrame) -> DataFrame:
    """The non-null cells of :func:`wide_table` as ``subject, attribute, cell``, cells written as text."""
    wide = wide_table(facts, catalog)
    names = [(f.name, f.dataType.simpleString()) for f in wide.schema.fields[1:]]
    if not names:
        return wide.selectExpr("subject", "cast(null as string) attribute", "cast(null as string) cell").limit(0)
    pairs = F.array(*(F.struct(F.lit(n).alias("attribute"), F.col(f"`{n}`").cast("string").alias("cell")) for n, _ in names))
    return wide.select("subject", F.explode(pairs).alias("p")).select("subject", "p.attribute", "p.cell").filter("cell is not null")
