"""Typed directive options: what each kind of directive knows, in Python and as a column."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_TYPES = {str: "string", bool: "boolean", int: "int", float: "double", list: "array<string>"}


@dataclass(frozen=True)
class OptionSpec:
    """Options by name with their type (str, bool, int, float, or list for words) and default."""

    fields: Mapping[str, tuple[type, object]]

    def extend(self, **more: tuple[type, object]) -> OptionSpec:
        """These options and more."""
        return OptionSpec({**self.fields, **more})

    def read(self, raw: Mapping[str, str]) -> dict[str, object]:
        """Typed values of raw ones: ``none`` and ``null`` are None, absent options have their default, others are left out."""
        return {name: self._typed(kind, raw[name], name) if raw.get(name) is not None else default for name, (kind, default) in self.fields.items()}

    @staticmethod
    def _typed(kind: type, value: str, name: str) -> object:
        low = value.lower()
        if low in ("none", "null"):
            return None
        if kind is bool:
            return low in ("true", "yes", "1", "")
        if kind is list:
            return value.split()
        try:
            return kind(value)
        except ValueError:
            raise ValueError(f"option {name!r}: {value!r} is no {kind.__name__}") from None

    def column(self, raw: Column) -> Column:
        """A struct of typed values of a map of raw ones; a number that cannot be read is null."""
        out = []
        for name, (kind, default) in self.fields.items():
            value = F.element_at(raw, name)
            low = F.lower(value)
            if kind is bool:
                typed = low.isin("true", "yes", "1", "")
            elif kind is list:
                typed = F.filter(F.split(value, r"(?U)\s+"), lambda x: x != "")
            elif kind is str:
                typed = value
            else:
                typed = F.trim(value).try_cast(_TYPES[kind])
            typed = F.when(low.isin("none", "null"), F.lit(None)).otherwise(typed)
            absent = F.lit(None) if default is None else F.array(*map(F.lit, default)) if kind is list else F.lit(default)
            out.append(F.when(value.isNull(), absent).otherwise(typed).cast(_TYPES[kind]).alias(name))
        return F.struct(*out)


_TEXT = (str, None)
STYLED = OptionSpec({"class": _TEXT, "name": _TEXT})
_IMAGE = STYLED.extend(width=_TEXT, height=_TEXT, alt=_TEXT, align=_TEXT)
#: options by kind of directive (fixed values)
OPTIONS: dict[str, OptionSpec] = {
    "admonition": STYLED.extend(collapsible=(bool, False), open=(bool, True)),
    "container": STYLED,
    "dropdown": STYLED.extend(open=(bool, False), icon=_TEXT, badge=_TEXT, color=_TEXT, description=_TEXT),
    "tab-item": STYLED.extend(selected=(bool, False), icon=_TEXT, badge=_TEXT, disabled=(bool, False), sync=_TEXT),
    "tab-set": STYLED.extend(id=_TEXT, sync=_TEXT, mode=_TEXT),
    "code-block": OptionSpec({"language": _TEXT, "linenos": (bool, False), "lineno_start": (int, 1), "emphasize_lines": _TEXT, "caption": _TEXT}),
    "image": _IMAGE,
    "figure": _IMAGE.extend(figwidth=_TEXT, figclass=_TEXT),
}
