"""Tables, views, roles and policies as they are kept in the manifest."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from tidemark.functions.typed import DECIMAL_SCALE, spark_type
from tidemark.plans.emit import Field
from tidemark.plans.syntax import ColumnDef, ForeignKey


@dataclass
class Column:
    name: str
    type: str
    stored: str  # the column's name in the files, which a rename leaves as it is
    scale: int = 0
    width: int = 0
    not_null: bool = False
    default: str | None = None
    serial: bool = False

    @classmethod
    def of(cls, d: ColumnDef, stored: str | None = None) -> "Column":
        scale = (d.args[1] if len(d.args) > 1 else 0 if d.args else DECIMAL_SCALE) if d.type == "decimal" else 0
        width = d.args[0] if d.type == "vector" and d.args else 0
        return cls(d.name, d.type, stored or d.name, scale, width, d.not_null or d.primary, d.default, d.serial)

    @property
    def spark(self) -> str:
        return spark_type(self.type, self.scale)


@dataclass
class Policy:
    name: str
    command: str
    to: list[str]
    using: str | None
    check: str | None


@dataclass
class Table:
    name: str
    columns: list[Column]
    owner: str
    uniques: list[list[str]] = field(default_factory=list)
    primary: list[str] = field(default_factory=list)
    checks: list[str] = field(default_factory=list)
    foreign: list[ForeignKey] = field(default_factory=list)
    indexes: dict[str, dict] = field(default_factory=dict)
    rls: bool = False
    force: bool = False
    policies: list[Policy] = field(default_factory=list)
    grants: dict[str, list[str]] = field(default_factory=dict)
    inserts: list[list] = field(default_factory=list)  # [xid, statement, path]
    deletes: list[list] = field(default_factory=list)
    cuts: list[list] = field(default_factory=list)  # [xid, inserts, deletes]: how many of each a TRUNCATE put out of sight
    peaks: dict = field(default_factory=dict)  # of SERIAL columns, and the number of files they hold for

    def column(self, name: str) -> Column | None:
        return next((c for c in self.columns if c.name == name), None)

    @property
    def fields(self) -> list[Field]:
        return [Field(c.name, c.type, c.scale) for c in self.columns]

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]


@dataclass
class Role:
    name: str
    superuser: bool = False
    login: bool = False
    createrole: bool = False
    bypassrls: bool = False
    password: str | None = None
    member_of: list[str] = field(default_factory=list)


@dataclass
class Catalog:
    tables: dict[str, Table] = field(default_factory=dict)
    views: dict[str, dict] = field(default_factory=dict)
    roles: dict[str, Role] = field(default_factory=dict)
    next_xid: int = 1
    next_statement: int = 1

    def to_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def of(cls, d: dict) -> "Catalog":
        def table(t: dict) -> Table:
            t = dict(t)
            t["columns"] = [Column(**c) for c in t["columns"]]
            t["foreign"] = [ForeignKey(**f) for f in t["foreign"]]
            t["policies"] = [Policy(**p) for p in t["policies"]]
            return Table(**t)

        return cls({k: table(t) for k, t in d["tables"].items()}, d["views"], {k: Role(**r) for k, r in d["roles"].items()}, d["next_xid"], d["next_statement"])
