"""Column names that input columns cannot clash with."""

from __future__ import annotations

from pyspark.sql import DataFrame


def free_name(wanted: str, columns: list[str]) -> str:
    """The name, with underscores in front until no column has it."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def hide(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with columns that start with an underscore, as helper columns do, renamed,
    and the names to give back, by new name. Without such columns ``df`` is as it was."""
    back, columns = {}, list(df.columns)
    for name in df.columns:
        if name.startswith("_"):
            new = f"hidden{len(back)}"
            while new in {c.lower() for c in columns}:
                new += "x"
            back[new] = name
            columns.append(new)
    new_of = {old: new for new, old in back.items()}
    return (df.toDF(*[new_of.get(c, c) for c in df.columns]) if back else df), back


def hidden_name(name: str, back: dict[str, str]) -> str:
    """The name a column has after ``hide``."""
    return {old: new for new, old in back.items()}.get(name, name)


def show(df: DataFrame, back: dict[str, str]) -> DataFrame:
    """``df`` with the names ``hide`` took away."""
    return df.toDF(*[back.get(c, c) for c in df.columns]) if back else df
