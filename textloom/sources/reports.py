"""Report tables as lines of Markdown, from evaluation blocks of some dozens of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame


def number(x: float | None, spec: str = ".2f") -> str:
    return "-" if x is None else format(x, spec)


def table(head: tuple[str, ...], rows: list[tuple[str, ...]]) -> list[str]:
    return ["| " + " | ".join(head) + " |", "|" + "---|" * len(head), *("| " + " | ".join(r) + " |" for r in rows)]


def of_family(blocks: DataFrame, family: str) -> list:
    return blocks.where(blocks["family"] == family).orderBy("of").collect()  # a row a group


def cell_table(blocks: DataFrame) -> list[str]:
    """What the threshold does in each cell."""
    rows = []
    for r in of_family(blocks, "cell"):
        if r["auroc"] is None:
            rows.append((r["of"], "-", "-", "-", "-"))
        else:
            rows.append((r["of"], number(r["auroc"]), f"{number(r['tpr'], '.0%')} of {r['n_pos']}", f"{r['fp']} of {r['n_neg']}", number(r["fpr_upper"], ".1%")))
    return table(("cell", "AUROC", "machine caught", "humans flagged", "upper bound"), rows)


def side_table(blocks: DataFrame, family: str) -> list[str]:
    rows = [(r["of"], str(r["n_pos"]), number(r["auroc"]), number(r["tpr"], ".0%")) for r in of_family(blocks, family)]
    return table((family, "texts", "AUROC against humans", "caught at the threshold"), rows)


def detector_table(scores: DataFrame) -> list[str]:
    """scores (detector, of, auroc): a line a detector, a column a cell."""
    found = {(r["detector"], r["of"]): r["auroc"] for r in scores.collect()}  # detectors times cells
    cells = sorted({of for _, of in found})
    return table(("detector", *cells), [(d, *(number(found.get((d, of))) for of in cells)) for d in sorted({d for d, _ in found})])
