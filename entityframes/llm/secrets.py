"""Secret scans with structural confirmation.

Three plain patterns report by their form alone (``assign``, ``access``, ``hex``). Everything else that
looks like base64 or hex is only a candidate: it is decoded and reported if its inside is that of a
key or a signed token:

* ``jwt``: header and claims decode to JSON objects (white space before them counts) and the header names an algorithm;
* ``der``: an ASN.1 private key: nested lengths fit exactly and the fields are those of a PKCS#1, PKCS#8, encrypted
  PKCS#8 or SEC1 key; also the body of PEM armour with encryption headers, if those and its length fit;
* ``ssh``: an OpenSSH private key: magic, then length-prefixed fields that fit.

A key says how long it is, so as many digits as it needs are read from its begin on: its lines may end in real or
escaped line ends (as in JSON or source text), and it may stand behind or before a sign that base64 uses itself.
Candidates are base64 of either alphabet, hex, and base64 of a whole armoured key. Spans count code points, ends are
exclusive.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "jwt", "der", "ssh")
_RANK = {k: i for i, k in enumerate(KINDS)}
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ASSIGN_HINT = re.compile(r"passw|secret|token|api_?key", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
# a run of 16 or more is the whole run: the look-behind only saves attempts inside shorter runs
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
# where a candidate may begin: 0x30 of a sequence, the OpenSSH magic, or armour, in base64 and in hex
_BEGINS = r"(?:(?<![A-Za-z0-9])|(?<=\\[nrt]))"
_BASE64_KEY = re.compile(_BEGINS + r"(?:M[A-P][A-Za-z0-9+/_-]{20}|b3BlbnNzaC1rZXktdjEA|LS0tLS1CRUdJTi)")
_HEX_KEY = re.compile(r"(?:(?<![0-9A-Fa-f])|(?<=\\[nrt])|(?<=0x))(?=(?:30[0-9A-Fa-f]{46}|6[Ff]70656[Ee]7373682[Dd]6[Bb]6579|65(?:79|77|33)[0-9A-Fa-f]{42}))")
_WRAP = r"[ \t]*(?:\r?\n|\\r\\n|\\n|\\r)(?:\r?\n|\\r\\n|\\n|\\r|[ \t]|\\t)*"
_BASE64_RUN = re.compile(rf"[A-Za-z0-9+/_-]+(?:{_WRAP}[A-Za-z0-9+/_-]+)*={{0,2}}")
_HEX_RUN = re.compile(rf"[0-9A-Fa-f]+(?:{_WRAP}[0-9A-Fa-f]+)*")
_WRAPS = re.compile(_WRAP)
_PEM_BEGIN = re.compile(r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY-----")
_PEM_END = re.compile(rb"-----END [A-Z0-9 ]{0,40}PRIVATE KEY-----")
_ARMOUR = re.compile(rb"-----BEGIN ")
_PEM_HEADER = re.compile(rf"[A-Za-z-]+: [^\r\n\\]*(?:{_WRAP})")
_DEK = re.compile(r"Proc-Type: 4,ENCRYPTED.*?DEK-Info: [A-Z0-9-]+,([0-9A-Fa-f]{16}|[0-9A-Fa-f]{32})(?![0-9A-Fa-f])", re.S)
_DOTTED = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+)+\.?[A-Za-z0-9_-]*")
_TOKEN_BEGIN = re.compile(r"(?<![A-Za-z0-9])[eICD]")
# Object identifiers of encryption by a password (PKCS#5, and PKCS#12's own)
_PBE = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))
_SSH_MAGIC = b"openssh-key-v1\0"


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the three plain patterns, leftmost and non-overlapping within a kind."""
    out = []
    if _ASSIGN_HINT.search(text):
        out += [(*m.span(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(*m.span(), "access") for m in _ACCESS.finditer(text)]
    out += [(*m.span(), "hex") for m in _HEX.finditer(text)]
    return out


def unbase64(run: str) -> bytes | None:
    run = run.rstrip("=").translate({0x2D: "+", 0x5F: "/"})
    if len(run) % 4 == 1:
        return None
    try:
        return base64.b64decode(run + "=" * (-len(run) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_nodes(data: bytes, depth: int = 0) -> list[tuple[int, bytes]] | None:
    """(tag, content) of the values that fill ``data`` exactly; None if a length does not fit."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data) or depth > 8:
            return None
        tag, size = data[at], data[at + 1]
        at += 2
        if size & 0x80:
            k = size & 0x7F
            if not 1 <= k <= 4 or at + k > len(data):
                return None
            size = int.from_bytes(data[at : at + k], "big")
            if size < 0x80 or (k > 1 and data[at] == 0):
                return None  # not the shortest form
            at += k
        if at + size > len(data):
            return None
        out.append((tag, data[at : at + size]))
        at += size
    return out


def is_der_key(data: bytes | None) -> bool:
    """Whether ``data`` is an ASN.1 private key: PKCS#1 (RSA), PKCS#8, plain or encrypted, or SEC1 (EC)."""
    if not data or data[0] != 0x30:
        return False
    outer = der_nodes(data)
    if not outer or len(outer) != 1:
        return False
    fields = der_nodes(outer[0][1], 1)
    if fields and [t for t, _ in fields] == [0x30, 0x04] and fields[1][1]:  # encrypted PKCS#8
        algorithm = der_nodes(fields[0][1], 2)
        return bool(algorithm) and algorithm[0][0] == 0x06 and algorithm[0][1].startswith(_PBE) and algorithm[-1][0] == 0x30 and der_nodes(algorithm[-1][1], 3) is not None
    if not fields or fields[0][0] != 0x02 or fields[0][1] not in (b"\0", b"\1"):
        return False
    tags = [tag for tag, _ in fields]
    if len(tags) >= 9 and all(t == 0x02 for t in tags[:9]) and all(f[1] for f in fields[:9]):
        return True
    if tags[1:3] == [0x30, 0x04]:  # algorithm, then the key as an octet string
        algorithm = der_nodes(fields[1][1], 2)
        return bool(algorithm) and algorithm[0][0] == 0x06 and der_nodes(fields[2][1], 2) is not None
    return len(tags) >= 2 and tags[1] == 0x04 and len(fields[1][1]) in (28, 32, 48, 66) and all(t in (0xA0, 0xA1) for t in tags[2:])


def der_size(head: bytes) -> int | None:
    """The size of the value that begins with ``head``, if that begins like a private key."""
    if len(head) < 8 or head[0] != 0x30:
        return None
    k = head[1] & 0x7F if head[1] & 0x80 else 0
    if k > 4 or (head[1] & 0x80 and not k):
        return None
    size = int.from_bytes(head[2 : 2 + k], "big") if k else head[1]
    inner = head[2 + k : 5 + k]
    return 2 + k + size if inner[:1] == b"\x30" or inner in (b"\2\1\0", b"\2\1\1") else None


def ssh_size(read: Callable[[int, int], bytes], length: int) -> int | None:
    """The size of the OpenSSH key that ``length`` bytes begin with, by the lengths of its fields; ``read`` gives (offset, number) bytes."""
    if read(0, len(_SSH_MAGIC)) != _SSH_MAGIC:
        return None
    at = len(_SSH_MAGIC)
    for k in range(6):  # cipher, kdf, its options, number of keys, public key, private part
        if at + 4 > length:
            return None
        value = int.from_bytes(read(at, 4), "big")
        at += 4
        if k == 3:
            if not 1 <= value <= 16:
                return None
        elif at + value > length or (k == 0 and not value) or (k == 5 and value % 8):
            return None
        else:
            at += value
    return at


def is_ssh_key(data: bytes | None) -> bool:
    return bool(data) and ssh_size(lambda at, n: data[at : at + n], len(data)) == len(data)


def _begins_object(part: str) -> bool:
    """Whether base64 text may be a JSON object: cheap, from the first characters."""
    head = (unbase64(part[:64]) or b"").lstrip(b" \t\r\n")
    return head[:1] == b"{" and head[1:].lstrip(b" \t\r\n")[:1] in (b'"', b"}", b"")


def is_jwt(header: str, claims: str) -> bool:
    try:
        head, body = (json.loads(unbase64(p) or b"") for p in (header, claims))
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and bool(head["alg"]) and isinstance(body, dict)


def tokens(text: str) -> Iterator[tuple[int, int]]:
    """The spans of signed tokens."""
    for m in _DOTTED.finditer(text):
        parts, at, free = m[0].split("."), m.start(), m.start()
        for k, header in enumerate(parts[:-2]):
            end = at + sum(map(len, parts[k : k + 3])) + 2
            # the token may begin behind a sign of base64 itself
            if at >= free and _begins_object(parts[k + 1]):
                for start in _TOKEN_BEGIN.finditer(header):
                    if _begins_object(header[start.start() :]) and is_jwt(header[start.start() :], parts[k + 1]):
                        yield at + start.start(), end
                        free = end
                        break
            at += len(header) + 1


class _Run:
    """The digits of base64 or hex from a place on, over wrapped lines; any part is decoded by itself, a whole phase once."""

    def __init__(self, text: str, start: int, pattern: re.Pattern, hexed: bool):
        self.text, self.start, self.end = text, start, pattern.match(text, start).end()
        self.group, self.width, self.hexed = (2, 1, True) if hexed else (4, 3, False)
        pieces, self.places, self.firsts, at = [], [], [], start
        for wrap in [*_WRAPS.finditer(text, start, self.end), None]:
            self.places.append(at)
            self.firsts.append(sum(map(len, pieces[-1:])) + (self.firsts[-1] if self.firsts else 0))
            pieces.append(text[at : wrap.start() if wrap else self.end])
            at = wrap.end() if wrap else self.end
        self.digits = "".join(pieces).rstrip("=")
        self.phases: dict[int, tuple[bytes, list[int], list[int], list[tuple[int, int]]]] = {}

    def index(self, place: int) -> int:
        """The number of the digit at a place of the text."""
        k = bisect_right(self.places, place) - 1
        return self.firsts[k] + place - self.places[k]

    def decode(self, digits: str) -> bytes:
        return bytes.fromhex(digits[: len(digits) // 2 * 2]) if self.hexed else unbase64(digits[: len(digits) - (len(digits) % 4 == 1)]) or b""

    def length(self, i: int) -> int:
        """How many bytes the digits from ``i`` on hold."""
        return (len(self.digits) - i) * self.width // self.group

    def read(self, i: int, at: int, n: int) -> bytes:
        """``n`` bytes from byte ``at`` of what begins at digit ``i``."""
        first, last = at // self.width * self.group, -(-(at + n) // self.width) * self.group
        return self.decode(self.digits[i + first : i + last])[at % self.width :][:n]

    def phase(self, i: int) -> tuple[bytes, int, list[int], list[int], list[tuple[int, int]]]:
        """All bytes in the phase of digit ``i``, where ``i`` is in them, and the begins, ends and dotted words among them."""
        k = i % self.group
        if k not in self.phases:
            data = self.decode(self.digits[k:])
            dotted = [m.span() for m in _DOTTED.finditer(data.decode("latin-1"))] if self.hexed else []
            self.phases[k] = data, [m.start() for m in _ARMOUR.finditer(data)], [m.end() for m in _PEM_END.finditer(data)], dotted
        data, *found = self.phases[k]
        return data, (i - k) // self.group * self.width, *found

    def after(self, i: int, n: int) -> int | None:
        """The place in the text behind the ``n`` bytes that begin at digit ``i``; None if their last piece goes on in letters or digits."""
        last = i + math.ceil(n * self.group / self.width)
        k = bisect_left(self.firsts, last) - 1
        at = self.places[k] + last - self.firsts[k]
        whole = k + 1 < len(self.firsts) and last == self.firsts[k + 1] or last == len(self.digits)
        while self.text[at : at + 1] == "=":
            at += 1
        return None if self.text[at : at + 1].isalnum() and not whole else at


def _keys(text: str) -> Iterator[tuple[int, int, str]]:
    """The spans of keys in base64 or hex, each as long as the key says."""
    for pattern, digits, hexed in ((_BASE64_KEY, _BASE64_RUN, False), (_HEX_KEY, _HEX_RUN, True)):
        free, run = 0, None
        for m in pattern.finditer(text):
            start = m.start()
            if start < free:
                continue
            if run is None or start >= run.end:
                run = _Run(text, start, digits, hexed)
            i, kind = run.index(start), None
            head, left = run.read(i, 0, 12), run.length(i)
            size = der_size(head)
            if size is not None:
                kind = "der" if size <= left and is_der_key(run.read(i, 0, size)) else None
            elif head[:11] == _SSH_MAGIC[:11]:
                size = ssh_size(partial(run.read, i), left)
                kind = "ssh" if size is not None else None
            elif head[:11] == b"-----BEGIN ":
                data, at, begins, ends, _ = run.phase(i)
                k, n = bisect_right(begins, at), bisect_right(ends, at)
                # armour ends before other armour begins
                if n < len(ends) and (k == len(begins) or ends[n] <= begins[k]):
                    size = ends[n] - at
                    kind = next((found for _, _, found in confirmed_spans(data[at : ends[n]].decode("latin-1"))), None)
            elif hexed and head[:1] != b"\x30":
                data, at, _, _, dotted = run.phase(i)
                k = bisect_right(dotted, (at, len(data))) - 1
                if k >= 0 and dotted[k][0] <= at < dotted[k][1] and (dotted[k][0] == at or not data[at - 1 : at].isalnum()):
                    first = next(tokens(data[at : dotted[k][1]].decode("latin-1")), (1, 0))
                    kind, size = ("jwt", first[1]) if first[0] == 0 else (None, 0)
            end = run.after(i, size) if kind else None
            if end is not None:
                free = end
                yield start, end, kind


def _armoured(text: str) -> Iterator[tuple[int, int, str]]:
    """The bodies of PEM armour that are keys; a body ends before the next armour begins."""
    begins = list(_PEM_BEGIN.finditer(text))
    for k, m in enumerate(begins):
        end = text.find("-----END", m.end(), begins[k + 1].start() if k + 1 < len(begins) else len(text))
        if end < 0:
            continue
        body, at = text[m.end() : end], 0
        lead = re.match(rf"(?:{_WRAP}|\s)*", body).end()
        at = lead
        while header := _PEM_HEADER.match(body, at):
            at = header.end()
        inner = body[at:]
        close = re.search(r"(?:\s|\\[nrt])*\Z", inner[-64:])
        close = len(inner) - (len(inner[-64:]) - close.start())
        data = unbase64("".join(_WRAPS.sub("", inner[:close]).split()))
        sealed = _DEK.search(body, 0, at)
        kind = "der" if is_der_key(data) else "ssh" if is_ssh_key(data) else "der" if sealed and data and len(data) % (len(sealed[1]) // 2) == 0 else None
        if kind:
            yield m.end() + at, m.end() + at + close, kind


def confirmed_spans(text: str) -> list[tuple[int, int, str]]:
    """Decoded candidates whose structure is that of a key or a signed token."""
    out = [(start, end, "jwt") for start, end in tokens(text)]
    out += _keys(text)
    if "PRIVATE KEY-----" in text:
        known = [s[:2] for s in out]
        out += [s for s in _armoured(text) if not any(a < s[1] and s[0] < b for a, b in known)]
    return out


def written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in sorted(spans, key=lambda s: (s[0], _RANK[s[2]], s[1])))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base array of (start, end, kind), confirmed array of the same): one row per row of ``docs``.

    Whole texts are scanned. Null and empty texts have no spans. Rows that repeat an id are scanned
    each for itself; other columns are not carried. An empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    span = "array<struct<start:int,end:int,kind:string>>"
    names = ("start", "end", "kind")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t or "" for t in batch["text"]]
            base = [[dict(zip(names, s, strict=True)) for s in sorted(base_spans(t))] for t in texts]
            confirmed = [[dict(zip(names, s, strict=True)) for s in sorted(confirmed_spans(t))] for t in texts]
            yield pd.DataFrame({"doc_id": batch["doc_id"].to_numpy(), "base": base, "confirmed": confirmed})

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, f"doc_id {kind}, base {span}, confirmed {span}")


def span_digest(found: DataFrame) -> DataFrame:
    """doc_id, the counts of the plain kinds, base_sha256 and the written spans of ``find_secrets``."""
    rank = F.expr("map(" + ", ".join(f"'{k}', {i}" for k, i in _RANK.items()) + ")")

    def text_of(spans):
        ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("s"), rank[s["kind"]].alias("r"), s["end"].alias("e"), s["kind"].alias("k"))))
        return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["k"], s["s"].cast("string"), s["e"].cast("string"))), ",")

    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(text_of(F.col("base")), 256).alias("base_sha256"), text_of(F.concat("base", "confirmed")).alias("spans"))
