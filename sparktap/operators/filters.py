"""Row predicates: allowlists, the output filter, and syscall success. All are native, so they reach the scan."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparktap import schema


def allowed(values: list[int], *cols: str) -> Column:
    """Any of the columns is in the list; an empty list allows all. Entries that are no number are skipped."""
    good = [int(v) for v in values if str(v).lstrip("-").isdigit()]
    if not good:
        return F.lit(True)
    out = F.lit(False)
    for c in cols:
        out = out | F.col(c).isin(good)
    return out


def same_comm(col: str, name: str) -> Column:
    """Process names agree in the 15 characters that the kernel keeps."""
    return F.substring(F.col(col), 1, 15) == name[:15]


def inet_only(family: str = "family") -> Column:
    """Sockets of the IPv4 family; what has no family isn't captured."""
    return F.coalesce(F.col(family) == schema.AF_INET, F.lit(False))


@dataclass
class OutputFilter:
    """Conditions that must all hold; unset ones hold always. Protocols are display or enum names."""

    drop_parse_errors: bool = False
    drop_tls_only: bool = False
    protocols: list[str] = field(default_factory=list)
    ports: list[int] = field(default_factory=list)
    directions: list[str] = field(default_factory=list)
    min_body_bytes: int = 0

    @classmethod
    def of(cls, given: dict) -> OutputFilter:
        """From a mapping; unknown keys are an error that names them."""
        if extra := set(given) - set(cls.__dataclass_fields__):
            raise ValueError(f"unknown filter keys: {sorted(extra)}")
        return cls(**given)

    def column(self, protocol: str = "protocol", direction: str = "direction", body: str | Sequence[str] | None = None, parse_error: str | None = None) -> Column:
        """Cheap conditions come first. body: the column of the body's length, or several, of which the first known one counts."""
        out = F.lit(True)
        if self.protocols:
            known = {v.lower(): k for names in (schema.PROTOCOLS, schema.PROTOCOL_ENUMS) for k, v in names.items()}
            out = out & F.col(protocol).isin([known[p.lower()] for p in self.protocols if p.lower() in known])
        if self.drop_tls_only:
            out = out & (F.col(protocol) != schema.TLS)
        out = out & allowed(self.ports, "src_port", "dst_port")
        if self.directions:
            out = out & F.col(direction).isin([k for k, v in schema.DIRECTIONS.items() if v in {d.upper() for d in self.directions}])
        if self.min_body_bytes and body:
            known = F.coalesce(*([body] if isinstance(body, str) else body))
            out = out & F.coalesce(known >= self.min_body_bytes, F.lit(True))  # an unknown length passes
        if self.drop_parse_errors and parse_error:
            out = out & F.col(parse_error).isNull()
        return out


def syscall_ok(kind: str, ret: str = "ret") -> Column:
    return {"open": F.col(ret) >= 0, "write": F.col(ret) > 0, "read": F.col(ret) > 0, "connect": F.col(ret) == 0, "ssl_read_ex": F.col(ret) == 1}[kind]


def clip(payload: str = "payload", most: int = schema.MAX_PAYLOAD) -> tuple[Column, Column]:
    """The payload as captured, and whether it was cut."""
    return F.substring(F.col(payload), 1, most), F.length(payload) > most


def split_by_filter(df: DataFrame, keep: Column) -> tuple[DataFrame, DataFrame]:
    keep = F.coalesce(keep, F.lit(False))
    return df.where(keep), df.where(~keep)


def first_of_each(rows: DataFrame, by: str, order: list[str]) -> DataFrame:
    """One row for each value of `by` (null is one too), the first in the order: distinct values that keep their order.
    Rows are cut down map-side, so a value with most rows is no hot group. Rows that tie in the order go by their other columns."""
    rest = [c for c in rows.columns if c not in order]
    first = F.min(F.struct(*order, *rest)).alias("__first")
    return rows.groupBy(F.col(by).alias("__by")).agg(first).select(*[F.col("__first")[c].alias(c) for c in rows.columns])
