"""A store of remembered facts with similarity recall, over the embedded database."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans.lexer import SqlError
from tidemark.store.database import Database


class MemoryStore:
    """Facts of one tenant each. Recall is fenced by tenant in the engine: a session sees its own tenant's rows only."""

    def __init__(self, spark: SparkSession, root: str, width: int, table: str = "memories"):
        self.db = Database(spark, root)
        self.table, self.width = table, width

    def ensure_schema(self) -> None:
        """The table and its fence; nothing happens where they are there."""
        if self.table in self.db.log.catalog.tables:
            return
        t = self.table
        self.db.script(
            f"CREATE TABLE {t} (id SERIAL PRIMARY KEY, tenant TEXT NOT NULL, fact TEXT NOT NULL, embedding VECTOR({self.width}) NOT NULL);"
            f"ALTER TABLE {t} ENABLE ROW LEVEL SECURITY; GRANT SELECT, INSERT, DELETE ON {t} TO PUBLIC;"
            f"CREATE POLICY own ON {t} USING (tenant = current_user()) WITH CHECK (tenant = current_user())"
        )

    def _as(self, tenant: str, sql: str, params: list | None = None):
        if tenant not in self.db.log.catalog.roles:
            self.db.execute(f'CREATE ROLE "{tenant.replace(chr(34), chr(34) * 2)}"')
        held, self.db.role = self.db.role, tenant
        try:
            return self.db.execute(sql, params)
        finally:
            self.db.role = held

    def store(self, tenant: str, fact: str, embedding: list[float]) -> int:
        """Remember a fact; its id comes back."""
        out = self._as(tenant, f"INSERT INTO {self.table} (tenant, fact, embedding) VALUES ($1, $2, $3) RETURNING id", [tenant, fact, list(embedding)])
        return out.rows()[0][0]

    def store_many(self, tenant: str, facts: DataFrame) -> int:
        """Remember the rows of a DataFrame with columns ``fact`` and ``embedding``, in one write."""
        self.db.attach("incoming", facts)
        try:
            return self._as(tenant, f"INSERT INTO {self.table} (tenant, fact, embedding) SELECT $1, fact, embedding FROM incoming", [tenant]).count
        finally:
            del self.db.attached["incoming"]

    def recall(self, tenant: str, embedding: list[float], k: int = 5, metric: str = "<=>") -> list[tuple[int, str, float]]:
        """The ``k`` facts of the tenant nearest to ``embedding``: id, fact and distance."""
        if metric not in ("<->", "<=>", "<#>", "<+>"):
            raise SqlError(f"unknown metric {metric}")
        sql = f"SELECT id, fact, embedding {metric} $1 AS distance FROM {self.table} ORDER BY embedding {metric} $1, id LIMIT {int(k)}"
        return self._as(tenant, sql, [list(embedding)]).rows()

    def forget(self, tenant: str, memory_id: int) -> bool:
        return self._as(tenant, f"DELETE FROM {self.table} WHERE id = $1", [memory_id]).count > 0
