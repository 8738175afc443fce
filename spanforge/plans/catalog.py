"""Creating, building, dropping and listing indexes, with the options' rules."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from enum import StrEnum

from pyspark.sql import DataFrame

from ..operators import index as ix
from ..operators import vector
from .request import ArrayMode, IndexDefinition, IndexKey

#: The names that a WITH clause may have.
OPTIONS = (
    "nodes", "defer_build", "retain_deleted_xattr", "num_partition", "num_replica", "docKeySize", "secKeySize", "arrSize", "numDoc",
    "residentRatio", "replicaId", "dimension", "description", "similarity", "scan_nprobes", "train_list", "persist_full_vector", "sparsejl_dim",
)
NOT_SUPPORTED = "not supported"


class CatalogError(ValueError):
    pass


class State(StrEnum):
    CREATED = "created"
    READY = "ready"
    ACTIVE = "active"
    DELETED = "deleted"
    ERROR = "error"


QUANTIZER = re.compile(r"^IVF(?P<nlist>\d*),(?:PQ(?P<m>\d+)x(?P<bits>\d+)(?:FS)?|SQ(?P<sq>4|6|8)|SQfp16|RABITQ(?P<rabitq>[1-9]))$", re.IGNORECASE)
SPARSE = re.compile(r"^IVF(?P<nlist>\d*)(?:,NONE)?$", re.IGNORECASE)


@dataclass(frozen=True)
class Quantization:
    nlist: int | None
    kind: str
    m: int | None = None
    bits: int | None = None


def parse_description(text: str, dimension: int | None = None, sparse: bool = False) -> Quantization:
    """A description such as IVF,SQ8 or IVF1024,PQ8x8."""
    plain = text.replace(" ", "")
    if sparse:
        found = SPARSE.match(plain)
        if not found:
            raise CatalogError(f"description {text!r} of a sparse index")
        return Quantization(int(found["nlist"]) if found["nlist"] else None, "none")
    found = QUANTIZER.match(plain)
    if not found:
        raise CatalogError(f"description {text!r}")
    nlist = int(found["nlist"]) if found["nlist"] else None
    if nlist == 0:
        raise CatalogError("nlist has to be above 0")
    if found["m"]:
        m, bits = int(found["m"]), int(found["bits"])
        if m < 1 or not 1 <= bits <= 16 or (dimension and dimension % m):
            raise CatalogError(f"PQ{m}x{bits} of dimension {dimension}")
        return Quantization(nlist, "pq", m, bits)
    if found["rabitq"]:
        return Quantization(nlist, "rabitq", bits=int(found["rabitq"]))
    return Quantization(nlist, "sq", bits=int(found["sq"] or 16))


def _whole(options: dict, name: str, least: int) -> None:
    value = options.get(name)
    if value is None:
        return
    try:
        number = int(value)
    except (TypeError, ValueError):
        raise CatalogError(f"{name} has to be a number") from None
    if isinstance(value, bool) or number < least:
        raise CatalogError(f"{name} has to be {least} or more")


def validate(definition: IndexDefinition) -> dict:
    """The definition's options with defaults; raises CatalogError."""
    options = dict(definition.options)
    unknown = [o for o in options if o not in OPTIONS]
    if unknown:
        raise CatalogError(f"unknown options {unknown}")
    if not definition.primary and not definition.keys:
        raise CatalogError("an index needs keys")
    arrays = [k for k in definition.keys if k.array != ArrayMode.NONE]
    if len(arrays) > 1:
        raise CatalogError("an index has one array key at most")
    if any(k.missing for k in definition.keys[1:]):
        raise CatalogError("only the leading key can include missing")
    for name, least in (("num_partition", 1), ("scan_nprobes", 1), ("train_list", 0), ("num_replica", 0), ("dimension", 1), ("sparsejl_dim", 1)):
        _whole(options, name, least)
    if len(set(definition.partition_by)) != len(definition.partition_by):
        raise CatalogError("partition keys repeat")
    if any(k.expr in definition.partition_by for k in arrays):
        raise CatalogError("an array key can't be a partition key")
    options.setdefault("num_partition", definition.num_partition)
    vectors = [k for k in definition.keys if k.vector]
    if definition.include and not vectors:
        raise CatalogError("include columns are for vector indexes")
    if vectors:
        sparse = bool(options.get("sparsejl_dim"))
        options.setdefault("similarity", "DOT" if sparse else "L2_SQUARED")
        options.setdefault("scan_nprobes", 1)
        try:
            metric = vector.metric_of(options["similarity"])
        except vector.VectorError as e:
            raise CatalogError(str(e)) from None
        if sparse and metric != vector.Metric.DOT:
            raise CatalogError("sparse indexes take DOT only")
        if not sparse and "dimension" not in options:
            raise CatalogError("a dense vector index needs a dimension")
        parse_description(options.setdefault("description", "IVF" if sparse else "IVF,SQ8"), options.get("dimension"), sparse)
    return options


@dataclass
class Entry:
    definition: IndexDefinition
    source: DataFrame
    options: dict
    state: State = State.CREATED
    index: ix.Index | None = None


@dataclass
class Catalog:
    """Indexes by name. Building is lazy: it makes a plan, or a stored table if a folder is given."""

    folder: str | None = None
    entries: dict[str, Entry] = field(default_factory=dict)

    def create_primary(self, name: str, source: DataFrame, doc_id: str = "doc_id") -> Entry:
        return self.create(IndexDefinition(name, doc_id=doc_id, primary=True), source)

    def create(self, definition: IndexDefinition, source: DataFrame) -> Entry:
        if definition.name in self.entries:
            raise CatalogError(f"index {definition.name} exists")
        options = validate(definition)
        definition = replace(definition, num_partition=int(options["num_partition"]))
        entry = Entry(definition, source, options)
        self.entries[definition.name] = entry
        if not entry.options.get("defer_build"):
            self.build(definition.name)
        return entry

    def build(self, *names: str) -> None:
        for name in names:
            entry = self.by_name(name)
            if entry.state == State.ACTIVE:
                continue
            try:
                made = ix.build(entry.source, entry.definition)
                if self.folder:
                    path = f"{self.folder}/{name}"
                    ix.store(made, path)
                    made = made.with_rows(entry.source.sparkSession.read.parquet(path))
            except Exception:
                entry.state = State.ERROR
                raise
            entry.index, entry.state = made, State.ACTIVE

    def by_name(self, name: str) -> Entry:
        if name not in self.entries:
            raise CatalogError(f"no index {name}")
        return self.entries[name]

    def index(self, name: str) -> ix.Index:
        entry = self.by_name(name)
        if entry.index is None:
            raise CatalogError(f"index {name} is not built")
        return entry.index

    def names(self) -> list[str]:
        return sorted(self.entries)

    def drop(self, name: str) -> None:
        entry = self.entries.pop(self.by_name(name).definition.name)
        entry.state = State.DELETED
        if self.folder and entry.index is not None:
            spark = entry.source.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    def alter(self, name: str, **_: object) -> None:
        self.by_name(name)
        raise CatalogError(f"alter {NOT_SUPPORTED}: placement and replicas are the cluster's")

    def create_aggregate(self, *_: object) -> None:
        raise CatalogError(f"precomputed aggregates {NOT_SUPPORTED}")


def covering(entries: list[Entry], columns: set[str]) -> Entry | None:
    """The active index with the fewest columns that has all those asked for."""
    fit = []
    for e in entries:
        if e.index is not None and columns <= {k.name for k in e.index.keys} | set(e.index.includes) | {e.definition.doc_id}:
            fit.append((len(e.index.rows.columns), e.definition.name, e))
    return min(fit, key=lambda x: x[:2])[2] if fit else None


def simple(name: str, *columns: str, doc_id: str = "doc_id", **options: object) -> IndexDefinition:
    """A composite index over columns; a leading '-' makes a key descending."""
    keys = tuple(IndexKey(c.lstrip("-"), c.lstrip("-"), descending=c.startswith("-")) for c in columns)
    return IndexDefinition(name, keys, doc_id=doc_id, **options)
