"""Secret scans with structural confirmation.

Patterns alone report three kinds (``assign``, ``access``, ``hex``). Every run that could be base64 or hex is decoded
as well (base64 also across line breaks, be they real or written as \\n, with the key's own lengths saying where it
ends), and reported only if its bytes parse as a secret: a private key's DER with nested lengths that add up
(``der``), an OpenSSH private key blob (``openssh``), an armoured block around either (``pem``), or a signed token
whose header is a JSON object naming its algorithm (``jwt``).

Encrypted keys are reported if what surrounds the cipher text parses: the algorithm and its octets (PKCS#8), or the
named cipher with a vector and a body of its block size (older armour).

Whole texts are scanned row by row: no shuffle, no state, and work in proportion to the text's length. Defined results: a
null or empty text has no findings, an empty table gives an empty result; texts may be of any length; wrapped lines
inside a reported armour are not reported again; of equal findings one is reported, and of those that begin at one place
the order is that of ``KINDS``; repeated rows are scanned alike; overlapping findings of different kinds are all
reported, and ``redact`` blanks their union; extra columns pass through, and those with the name of a result (in any
case) are replaced by it.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import extended, free_name, others, text_steps

#: In order of rank among findings that begin at the same place. The first three are the base patterns.
KINDS = ("assign", "access", "hex", "pem", "der", "openssh", "jwt")
BASE = KINDS[:3]
ASSIGN = re.compile(
    r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal, so shorter ones simply do not match
#: One of these is in the lower-cased text wherever ASSIGN matches.
ASSIGN_HINTS = ("passw", "secret", "token", "api")
LEAST_VALUE, LEAST_ACCESS = 6, 20
ARMOUR = re.compile(r"-----(BEGIN|END) ((?:[A-Z0-9]+ ){0,8}PRIVATE KEY)-----")
ARMOURED = re.compile(r"(?:[A-Za-z0-9+/=\s:,.-]|\\+[nrt])*+")
#: Block sizes in bytes by the first part of a cipher's name.
CIPHERS = {"AES": 16, "DES": 8, "CAMELLIA": 16, "ARIA": 16, "SEED": 16, "BF": 8, "CAST5": 8, "IDEA": 8, "RC2": 8}
DEK = re.compile(r"DEK-Info:\s*([A-Za-z0-9]+)[A-Za-z0-9-]*,\s*([0-9A-Fa-f]+)")
#: A line break as it is written inside JSON and .env strings.
WRITTEN = re.compile(r"(?:\\+r)?\\+n|\\+r")
BREAK = r"(?:\r?\n|\r|(?:\\+r)?\\+n)[ \t]*"
#: Where a wrapped run may begin that holds a private key: the base64 of a DER sequence, of the OpenSSH magic, of armour.
BEGINS = re.compile(r"(?:(?<![A-Za-z0-9+/_-])|(?<=\\[nr]))(?:M[A-I]|b3B|LS0)")
#: Enough letters to see whether a DER sequence begins with a small version number.
HEAD = re.compile(rf"(?:[A-Za-z0-9+/_-](?:{BREAK})?){{12}}")
LINE = re.compile(rf"([A-Za-z0-9+/_-]+)(={{0,2}})({BREAK})?")
#: The base64 of a JSON object begins with these letters.
JWT = re.compile(r"(?<![A-Za-z0-9_-])e[yw][A-Za-z0-9_-]{6,}\.[A-Za-z0-9_-]{2,}\.[A-Za-z0-9_-]*")
#: Shorter runs cannot hold a private key.
ENCODED = re.compile(r"[A-Za-z0-9+/_-]{40,}={0,2}")
HEX_ANY = re.compile(r"(?:[0-9a-fA-F]{2}){20,}")
MASK = "[REDACTED]"


def unbase64(run: str) -> bytes | None:
    """The bytes of a base64 run in either alphabet, padding optional; None if it is not one."""
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def tlv(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """The tag, and where the value of the DER element at ``at`` begins and ends; None if it does not fit."""
    if at + 2 > end:
        return None
    tag, first, at = data[at], data[at + 1], at + 2
    if first >= 128:
        n = first & 127
        if not 1 <= n <= 4 or at + n > end or data[at] == 0:
            return None
        first, at = int.from_bytes(data[at : at + n], "big"), at + n
        if first < 128:
            return None
    return (tag, at, at + first) if at + first <= end else None


def children(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    out = []
    while at < end:
        if (element := tlv(data, at, end)) is None:
            return None
        out.append(element)
        at = element[2]
    return out


def private_der(data: bytes) -> bool:
    """PKCS#1, PKCS#8 or SEC 1: one sequence that fills the bytes, a small version number, then what that form needs."""
    outer = tlv(data, 0, len(data))
    if outer is None or outer[0] != 0x30 or outer[2] != len(data):
        return False
    parts = children(data, outer[1], outer[2])
    if not parts or len(parts) < 2 or parts[0][0] != 2 or parts[0][2] - parts[0][1] != 1 or data[parts[0][1]] > 1:
        return False
    tags = [p[0] for p in parts]
    if len(tags) >= 9 and set(tags[:9]) == {2}:
        return True
    if tags[1] == 0x30 and len(tags) >= 3 and tags[2] == 4:
        inner = children(data, parts[1][1], parts[1][2])
        return bool(inner) and inner[0][0] == 6
    return tags[1] == 4 and set(tags[2:]) <= {0xA0, 0xA1}


def encrypted_der(data: bytes) -> bool:
    """PKCS#8, encrypted: one sequence that fills the bytes, of an algorithm with an identifier and the octets."""
    outer = tlv(data, 0, len(data))
    if outer is None or outer[0] != 0x30 or outer[2] != len(data):
        return False
    parts = children(data, outer[1], outer[2])
    if not parts or [p[0] for p in parts] != [0x30, 4] or parts[1][2] - parts[1][1] < 16:
        return False
    inner = children(data, parts[0][1], parts[0][2])
    return bool(inner) and inner[0][0] == 6


def encrypted_armour(head: str, data: bytes) -> bool:
    """The older form: a cipher that is known, a vector of half a block or more, and whole blocks."""
    if not (named := DEK.search(head)):
        return False
    block = CIPHERS.get(named[1].upper())
    return bool(block and data) and len(data) % block == 0 and len(named[2]) in (16, 2 * block)


def private_openssh(data: bytes) -> bool:
    """The magic words, then counted strings whose lengths end exactly at the end."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    at, fields = len(magic), 0
    while at < len(data):
        if fields == 3:  # the number of keys
            at += 4
            fields += 1
            continue
        if at + 4 > len(data):
            return False
        at += 4 + int.from_bytes(data[at : at + 4], "big")
        fields += 1
    return at == len(data) and fields >= 6


def confirmed(data: bytes | None) -> str | None:
    if not data:
        return None
    if data[0] == 0x30 and private_der(data):
        return "der"
    if private_openssh(data):
        return "openssh"
    if data.startswith(b"-----BEGIN "):
        return "pem" if any(k == "pem" for k, _, _ in structural(data.decode("latin-1"))) else None
    return None


class Lines:
    """A run of base64 lines: its letters without the breaks, and where in the text they stand. Built once for all
    candidates in it."""

    def __init__(self, text: str, at: int):
        self.begin, parts = at, []
        self.starts: list[int] = []  # of the lines in the text
        self.upto = [0]  # letters up to the end of each line
        self.stops: list[int] = []  # ends of the lines in the text, padding included
        self.decoded: dict[int, tuple[bytes, list[int]]] = {}
        while line := LINE.match(text, at):
            parts.append(line[1])
            self.starts.append(line.start())
            self.upto.append(self.upto[-1] + len(line[1]))
            self.stops.append(line.end(2))
            at = line.end()
            if line[2] or not line[3]:
                break
        self.end, self.body = at, "".join(parts)

    def offset(self, at: int) -> int:
        """The letter at a place of the text."""
        k = bisect_right(self.starts, at) - 1
        return self.upto[k] + at - self.starts[k]

    def peek(self, first: int, at: int, n: int) -> bytes:
        """n bytes from byte ``at`` on of what begins at the letter ``first``; fewer where the run ends."""
        piece = self.body[first + at // 3 * 4 : first + -(-(at + n) // 3) * 4]
        piece = piece[: len(piece) - (len(piece) % 4 == 1)]
        return (unbase64(piece) or b"")[at % 3 : at % 3 + n]

    def length(self, first: int) -> int | None:
        """How many bytes a private key that begins at a letter has, as its own lengths say."""
        head = self.peek(first, 0, 15)
        if head[:1] == b"0":
            n = head[1] & 127 if head[1] >= 128 else 0
            return 2 + n + (int.from_bytes(head[2 : 2 + n], "big") if n else head[1])
        if head.startswith(b"-----BEGIN "):
            shift = first % 4  # decoded once for each of the four ways that letters fall into groups
            if shift not in self.decoded:
                rest = self.body[shift:]
                data = unbase64(rest[: len(rest) - (len(rest) % 4 == 1)]) or b""
                self.decoded[shift] = data, [m.end() for m in re.finditer(rb"-----END [A-Z0-9 ]{1,80}-----", data)]
            ends, begin = self.decoded[shift][1], (first - shift) // 4 * 3
            k = bisect_right(ends, begin)
            return ends[k] - begin if k < len(ends) else None
        at = 15
        for _ in range(3):
            at += 4 + int.from_bytes(self.peek(first, at, 4).rjust(4, b"\xff"), "big")
        keys = int.from_bytes(self.peek(first, at, 4).rjust(4, b"\xff"), "big")
        at += 4
        for _ in range(keys + 1 if keys <= 64 else 0):
            at += 4 + int.from_bytes(self.peek(first, at, 4).rjust(4, b"\xff"), "big")
        return at

    def stop(self, letters: int) -> int | None:
        """Where in the text a line ends with so many letters."""
        k = bisect_right(self.upto, letters) - 1
        return self.stops[k - 1] if k > 0 and self.upto[k] == letters else None


def wrapped(text: str, within: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Keys whose base64 goes on over line breaks, or begins after one that is written out."""
    out, done, lines = [], 0, None
    armour = [(a, b) for _, a, b in within]
    for m in BEGINS.finditer(text):
        if m.start() < done or not (head := HEAD.match(text, m.start())):
            continue
        start = unbase64("".join(x[1] for x in LINE.finditer(head[0]))[:12]) or b""
        if start[:1] == b"0":
            n = start[1] & 127 if start[1] >= 128 else 0
            if n > 4 or start[2 + n : 4 + n] != b"\x02\x01" or start[4 + n] > 1:
                continue
        elif not (b"openssh-key-v1".startswith(start) or b"-----BEGIN ".startswith(start)):
            continue
        k = bisect_right(armour, (m.start(), len(text))) - 1
        if k >= 0 and m.start() < armour[k][1]:
            continue
        if lines is None or m.start() >= lines.end:
            lines = Lines(text, m.start())
        first = lines.offset(m.start())
        size = lines.length(first)
        for more in range(3 if start[:1] == b"-" else 1):  # an armour's last line break may be part of it
            if size is None or not (stop := lines.stop(first + -(-(size + more) * 8 // 6))):
                continue
            if kind := confirmed(unbase64(lines.body[first : first + -(-(size + more) * 8 // 6)])):
                out.append((kind, m.start(), stop))
                done = stop
                break
    return out


def signed_token(run: str) -> bool:
    head, body, _ = run.split(".", 2)
    try:
        parts = [json.loads(unbase64(x) or b"") for x in (head, body)]
    except (ValueError, RecursionError):
        return False
    return isinstance(parts[0], dict) and isinstance(parts[0].get("alg"), str) and isinstance(parts[1], dict)


def armoured(text: str) -> list[tuple[str, int, int]]:
    """Blocks between a BEGIN line and the next END line of the same name, if what they hold parses. Every marker is
    found once and paired with its neighbour."""
    out, begin = [], None
    for m in ARMOUR.finditer(text):
        if m[1] == "BEGIN":
            begin = m
            continue
        if begin is not None and begin[2] == m[2] and ARMOURED.match(text, begin.end(), m.start()).end() == m.start():
            held = WRITTEN.sub("\n", text[begin.end() : m.start()]).replace("\\t", " ")
            body = "".join(line for line in held.splitlines() if ":" not in line).replace(" ", "").replace("\t", "")
            data = unbase64(body) or b""
            if "ENCRYPTED" in m[2]:
                found = encrypted_der(data)
            elif "ENCRYPTED" in held:
                found = encrypted_armour(held, data)
            else:
                found = private_der(data) or private_openssh(data)
            if found:
                out.append(("pem", begin.start(), m.end()))
        begin = None
    return out


def structural(text: str) -> list[tuple[str, int, int]]:
    """What decoding and parsing confirms."""
    out = armoured(text) if "-----BEGIN " in text else []
    out += wrapped(text, out)
    for m in ENCODED.finditer(text):
        if kind := confirmed(unbase64(m[0])):
            out.append((kind, m.start(), m.end()))
    for m in HEX_ANY.finditer(text):
        if kind := confirmed(bytes.fromhex(m[0])):
            out.append((kind, m.start(), m.end()))
    return out + [("jwt", m.start(), m.end()) for m in JWT.finditer(text) if signed_token(m[0])]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    low = text.lower()
    if any(h in low for h in ASSIGN_HINTS):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    return out + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def ordered(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(set(spans), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def find(text: str | None) -> list[tuple[str, int, int]]:
    """All findings in a text: (kind, start, end) in code points, end exclusive."""
    return ordered(base_spans(text) + structural(text)) if text else []


def mask(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with the union of the spans replaced."""
    if not spans:
        return text
    out, at, begin, end = [], 0, *spans[0][1:]
    for _, s, e in [*spans[1:], ("", len(text) + 1, 0)]:
        if s > end:
            out += [text[at:begin], MASK]
            at, begin, end = end, s, e
        else:
            end = max(end, e)
    return "".join([*out, text[at:]])


def scan_secrets(
    df: DataFrame, text: str = "text", masked: str | None = None, name: str = "secrets"
) -> DataFrame:
    """df with ``name``, an array of (kind, start, end), and, if named, a column of masked texts."""
    names = others(df, name, masked)
    item = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
    own = [F.col(f"`{c}`") for c in names]
    base = df.select(*own, F.col(f"`{text}`").alias(free_name(df, "__text")))
    item_type = T.StructType().add("kind", "string").add("start", "integer").add("end", "integer")
    more = [(masked, "string")] if masked else []
    schema = extended(df.select(*own), (name, T.ArrayType(item_type)), *more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_steps(batch, len(names)):
                texts = part.column(len(names)).to_pylist()
                found = [find(t) for t in texts]
                values = [[{"kind": k, "start": s, "end": e} for k, s, e in f] for f in found]
                columns = [*part.columns[:-1], pa.array(values, pa.list_(item))]
                if masked:
                    columns.append(pa.array([mask(t, f) for t, f in zip(texts, found)], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=[*names, name, *([masked] if masked else [])])

    return base.mapInArrow(run, schema)


def redact(docs: DataFrame) -> DataFrame:
    """Documents with their secrets masked and ``n_chars`` brought up to date; their columns stay as they are."""
    masked, found = free_name(docs, "__masked"), free_name(docs, "__secrets")
    out = scan_secrets(docs, "text", masked, found)
    new = {"text": F.col(masked)}
    if "n_chars" in docs.columns:
        changed = F.length(masked).cast(docs.schema["n_chars"].dataType)
        new["n_chars"] = F.when(F.size(found) > 0, changed).otherwise(F.col("n_chars"))
    return out.select(*(new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns))
