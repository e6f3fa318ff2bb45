"""Which field sits where: builds requests, survives as JSON, and refuses what cannot be."""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field, replace
from pathlib import Path

from crossloom.functions.display import Format, Rule

from .errors import PivotError
from .request import Aggregation, Filter, PivotRequest, RowSort, ShowAs, SortBy, Value

AREAS = ("row", "column", "data", "filter", "available")
VERSION = 1


@dataclass(frozen=True)
class Field:
    """A field of the catalog. Measures go to data only, dimensions anywhere else; a field without a role
    takes it from its area."""

    name: str
    caption: str = ""
    area: str = "available"
    role: str = ""
    aggregation: Aggregation = Aggregation.SUM
    show_as: ShowAs = ShowAs.NORMAL
    format: Format | None = None
    filter_values: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if not self.name.strip():
            raise PivotError("a field name is blank")
        if self.area not in AREAS or self.role not in ("", "measure", "dimension"):
            raise PivotError(f"{self.name}: no such area or role")
        object.__setattr__(self, "role", self.role or ("measure" if self.area == "data" else "dimension"))
        object.__setattr__(self, "caption", self.caption or self.name)
        object.__setattr__(self, "filter_values", tuple("" if v is None else v for v in self.filter_values))
        if self.area != "available" and (self.area == "data") != (self.role == "measure"):
            raise PivotError(f"{self.name}: a {self.role} cannot be in area {self.area}")


@dataclass
class Layout:
    """Fields in order; the order within an area is the order of the request."""

    fields: list[Field]
    sort: RowSort = field(default_factory=RowSort)

    def __post_init__(self) -> None:
        names = [f.name.lower() for f in self.fields]
        if len(set(names)) < len(names):
            raise PivotError("a field is listed twice")

    def get(self, name: str) -> Field:
        for f in self.fields:
            if f.name.lower() == name.lower():
                return f
        raise PivotError(f"no field named {name!r}")

    def area(self, area: str) -> list[Field]:
        return [f for f in self.fields if f.area == area]

    def _put(self, new: Field, at: int | None = None) -> None:
        """Replaces the field of that name; with a place, moves it there within its area."""
        rest = [f for f in self.fields if f.name.lower() != new.name.lower()]
        if at is None:
            self.fields = [new if f.name.lower() == new.name.lower() else f for f in self.fields]
        else:
            inside = [i for i, f in enumerate(rest) if f.area == new.area]
            place = inside[at] if at < len(inside) else (inside[-1] + 1 if inside else len(rest))
            self.fields = [*rest[:place], new, *rest[place:]]
        self._settle()

    def _settle(self) -> None:
        """Drops a sort whose field or value has left."""
        keys = {Value(f.name, f.aggregation).key for f in self.area("data")}
        if self.sort.by is SortBy.ROW_LABEL and self.sort.field and self.sort.field.lower() not in {f.name.lower() for f in self.area("row")}:
            self.sort = RowSort()
        if self.sort.by in (SortBy.ROW_TOTAL, SortBy.COLUMN_VALUE) and self.sort.value_key not in keys:
            self.sort = RowSort()

    def move(self, name: str, area: str, at: int | None = None) -> None:
        own = self.get(name)
        if own.area == "data" and area != "data" and len(self.area("data")) == 1:
            raise PivotError("the last data field stays")
        self._put(replace(own, area=area), len(self.area(area)) if at is None else at)

    def remove(self, name: str) -> None:
        self.move(name, "available")

    def reorder(self, name: str, at: int) -> None:
        self.move(name, self.get(name).area, at)

    def change(self, name: str, **changes: object) -> None:
        """Sets aggregation, show_as, format, caption or filter_values; the first two on data fields only."""
        own = self.get(name)
        if own.area != "data" and {"aggregation", "show_as"} & set(changes):
            raise PivotError(f"{name} is not a data field")
        if "caption" in changes and not str(changes["caption"]).strip():
            raise PivotError("a caption is blank")
        self._put(replace(own, **changes))

    def set_filter(self, name: str, values: list[str | None]) -> None:
        self.change(name, filter_values=tuple(values))

    def clear_filters(self) -> None:
        self.fields = [replace(f, filter_values=()) for f in self.fields]

    def repaired(self) -> Layout:
        """With neither rows nor columns, the first available dimension becomes a row."""
        if not self.area("row") and not self.area("column"):
            for f in self.area("available"):
                if f.role == "dimension":
                    self.move(f.name, "row")
                    break
        return self

    def request(self) -> PivotRequest:
        values = tuple(Value(f.name, f.aggregation, f.show_as) for f in self.area("data"))
        filters = tuple(Filter(f.name, f.filter_values) for f in self.fields if f.filter_values)
        return PivotRequest(tuple(f.name for f in self.area("row")), tuple(f.name for f in self.area("column")), values, filters, self.sort)

    def filter_by_cell(self, row_path: list[str], column_path: list[str]) -> PivotRequest:
        """The request narrowed to a cell: its labels are filters and replace others on the same fields."""
        own = self.request()
        cell = dict(zip((*own.rows, *own.columns), (*row_path, *column_path)))
        kept = tuple(f for f in own.filters if f.field not in cell)
        return replace(own, filters=(*kept, *(Filter(k, (v,)) for k, v in cell.items())))

    def sort_by_header(self, sort: RowSort) -> None:
        """Sorts by a header; again by the same one turns the direction round."""
        same = replace(self.sort, descending=False) == replace(sort, descending=False)
        self.sort = replace(sort, descending=not self.sort.descending) if same else sort
        self._settle()

    def to_json(self) -> str:
        return json.dumps({"version": VERSION, "fields": [asdict(f) for f in self.fields], "sort": asdict(self.sort)})

    @classmethod
    def from_json(cls, text: str, declared: Layout | None = None) -> Layout:
        """A stored layout. If it has another version or no longer fits the declared fields, the declared layout."""
        try:
            state = json.loads(text)
            if state["version"] != VERSION:
                raise PivotError("another version")
            fields = [Field(**{**f, "aggregation": Aggregation(f["aggregation"]), "show_as": ShowAs(f["show_as"]), "format": Format(**f["format"]) if f["format"] else None, "filter_values": tuple(f["filter_values"])}) for f in state["fields"]]
            sort = RowSort(**{**state["sort"], "by": SortBy(state["sort"]["by"]), "column_path": tuple(state["sort"]["column_path"])})
            out = cls(fields, sort)
            if declared is not None and {f.name.lower() for f in fields} != {f.name.lower() for f in declared.fields}:
                raise PivotError("the fields have changed")
            return out
        except (KeyError, TypeError, ValueError):
            if declared is None:
                raise
            return declared


def picked(values: list[str], checked: set[str], hidden: set[str] = frozenset()) -> list[str]:
    """Filter values after a choice: everything checked means no restriction; values beyond a cut-off list stay accepted."""
    if not hidden and all(v in checked for v in values):
        return []
    return [v for v in values if v in checked] + sorted(hidden)


def shown_values(values: list[str], term: str) -> list[str]:
    return [v for v in values if term.strip().lower() in (v or "-").lower()]


def set_shown(values: list[str], checked: set[str], term: str, on: bool) -> set[str]:
    """Selects or clears what a search leaves in sight, and nothing else."""
    sight = set(shown_values(values, term))
    return checked | sight if on else checked - sight


@dataclass
class ViewStore:
    """Saved views in one JSON file: id, name, layout, rules and column widths (72 to 420)."""

    path: Path

    def _read(self) -> dict[str, dict]:
        return json.loads(self.path.read_text()) if self.path.exists() else {}

    def list(self) -> list[dict]:
        return sorted(self._read().values(), key=lambda v: v["name"].lower())

    def save(self, name: str, layout: Layout, rules: list[Rule] = (), widths: dict[str, int] | None = None, view_id: str | None = None) -> str:
        """Over the view with that id, else over the one of that name, else as a new one."""
        if not name.strip():
            raise PivotError("a view needs a name")
        views = self._read()
        key = view_id or next((k for k, v in views.items() if v["name"].lower() == name.strip().lower()), uuid.uuid4().hex)
        views[key] = {"id": key, "version": VERSION, "name": name.strip(), "layout": layout.to_json(), "rules": [asdict(r) for r in rules], "widths": {k: min(420, max(72, int(w))) for k, w in (widths or {}).items()}}
        self.path.write_text(json.dumps(views, ensure_ascii=False))
        return key

    def delete(self, view_id: str) -> bool:
        views = self._read()
        found = views.pop(view_id, None) is not None
        self.path.write_text(json.dumps(views, ensure_ascii=False))
        return found
