"""A small PDF writer: pages of text and rectangles in the standard Helvetica."""

from __future__ import annotations

import zlib

from .charts import Chart

WIDTH, HEIGHT = 595, 842


def _text(value: str) -> bytes:
    raw = value.encode("cp1252", "replace")
    return raw.replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)")


class Pdf:
    def __init__(self):
        self.pages: list[list[bytes]] = []

    def page(self) -> None:
        self.pages.append([])

    def text(self, x: float, y: float, size: float, value: str, bold: bool = False) -> None:
        """y counts from the top."""
        font = b"F2" if bold else b"F1"
        place = f"{size:.2f} Tf {x:.2f} {HEIGHT - y:.2f} Td ".encode()
        self.pages[-1].append(b"BT /" + font + b" " + place + b"(" + _text(value) + b") Tj ET")

    def box(self, x: float, y: float, width: float, height: float, colour: str) -> None:
        rgb = " ".join(f"{int(colour[i : i + 2], 16) / 255:.3f}" for i in (1, 3, 5))
        self.pages[-1].append(f"{rgb} rg {x:.2f} {HEIGHT - y - height:.2f} {width:.2f} {height:.2f} re f 0 0 0 rg".encode())

    def chart(self, chart: Chart, x: float, y: float, width: float, height: float) -> None:
        """The chart, scaled to fit."""
        scale = min(width / chart.width, height / chart.height)
        self.text(x, y + 12, 11, chart.title, bold=True)
        for bx, by, w, h, c in chart.boxes:
            self.box(x + bx * scale, y + by * scale, w * scale, h * scale, c)
        for tx, ty, size, value in chart.texts:
            self.text(x + tx * scale, y + ty * scale, max(3.0, size * scale), value)

    def save(self, path: str) -> None:
        n = len(self.pages)
        objects = [b"<< /Type /Catalog /Pages 2 0 R >>"]
        kids = " ".join(f"{5 + 2 * i} 0 R" for i in range(n))
        objects.append(f"<< /Type /Pages /Kids [{kids}] /Count {n} >>".encode())
        for name in ("Helvetica", "Helvetica-Bold"):
            objects.append(f"<< /Type /Font /Subtype /Type1 /BaseFont /{name} /Encoding /WinAnsiEncoding >>".encode())
        for i, page in enumerate(self.pages):
            body = zlib.compress(b"\n".join(page))
            objects.append(
                f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 {WIDTH} {HEIGHT}] /Contents {6 + 2 * i} 0 R "
                "/Resources << /Font << /F1 3 0 R /F2 4 0 R >> >> >>".encode()
            )
            objects.append(f"<< /Length {len(body)} /Filter /FlateDecode >>\nstream\n".encode() + body + b"\nendstream")
        out, places = bytearray(b"%PDF-1.4\n"), []
        for i, o in enumerate(objects, 1):
            places.append(len(out))
            out += f"{i} 0 obj\n".encode() + o + b"\nendobj\n"
        start = len(out)
        out += f"xref\n0 {len(objects) + 1}\n0000000000 65535 f \n".encode()
        out += b"".join(f"{p:010d} 00000 n \n".encode() for p in places)
        out += f"trailer\n<< /Size {len(objects) + 1} /Root 1 0 R >>\nstartxref\n{start}\n%%EOF\n".encode()
        with open(path, "wb") as f:
            f.write(bytes(out))
