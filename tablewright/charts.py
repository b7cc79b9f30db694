"""Charts as plain shapes, drawn as SVG or into a PDF page. Numbers come from Spark, already small."""

from __future__ import annotations

from dataclasses import dataclass, field
from html import escape

LABEL = 20
MOST_CLASSES = 20


def short(label: str, most: int = LABEL) -> str:
    label = str(label)
    return label if len(label) <= most else label[: most - 3] + "..."


@dataclass
class Chart:
    """A title and shapes on a canvas whose origin is the upper left corner: rectangles (x, y, width, height, colour)
    and texts (x, y, size, text)."""

    title: str
    width: float
    height: float
    boxes: list[tuple[float, float, float, float, str]] = field(default_factory=list)
    texts: list[tuple[float, float, float, str]] = field(default_factory=list)

    def svg(self) -> str:
        out = [
            f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {self.width:g} {self.height:g}" width="{self.width:g}">',
            f'<text x="8" y="18" font-size="14" font-weight="bold">{escape(self.title)}</text>',
        ]
        out += [f'<rect x="{x:g}" y="{y:g}" width="{w:g}" height="{h:g}" fill="{c}"/>' for x, y, w, h, c in self.boxes]
        out += [f'<text x="{x:g}" y="{y:g}" font-size="{s:g}">{escape(t)}</text>' for x, y, s, t in self.texts]
        return "".join(out) + "</svg>"


def bars(title: str, values: list[tuple[str, float]], colour: str = "#4477aa") -> Chart:
    """Horizontal bars, one for each name."""
    top = max((abs(v) for _, v in values), default=0) or 1
    chart = Chart(title, 640, 34 + 18 * len(values))
    for i, (name, v) in enumerate(values):
        y = 28 + 18 * i
        chart.texts.append((8, y + 12, 11, short(name)))
        chart.boxes.append((150, y, 400 * abs(v) / top, 14, colour))
        chart.texts.append((556, y + 12, 11, f"{v:.4g}"))
    return chart


def shade(value: float | None) -> str:
    """Blue for 1, white for 0, red for -1, grey for nothing."""
    if value is None or value != value:
        return "#cccccc"
    strength = int(255 * (1 - min(1.0, abs(value))))
    return f"#{strength:02x}{strength:02x}ff" if value >= 0 else f"#ff{strength:02x}{strength:02x}"


def heatmap(title: str, columns: list[str], rows: list[list[float | None]], labels: list[str] | None = None) -> Chart:
    cell = max(4.0, min(32.0, 640 / max(1, len(columns))))
    high = cell if labels else max(1.0, min(cell, 400 / max(1, len(rows))))
    left = 140 if labels else 20
    chart = Chart(title, left + cell * len(columns) + 20, 40 + high * len(rows) + 80)
    for j, row in enumerate(rows):
        if labels:
            chart.texts.append((8, 30 + high * (j + 0.7), min(10, high), short(labels[j])))
        chart.boxes += [(left + cell * i, 30 + high * j, cell, high, shade(v)) for i, v in enumerate(row)]
    for i, c in enumerate(columns):
        chart.texts.append((left + cell * i, 46 + high * len(rows) + 10 * (i % 6), 8, short(c, 12)))
    return chart
