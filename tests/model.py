"""Brute-force expectations on small inputs, from positions in the raw text."""

import random
import re
from itertools import accumulate

SPACES = [chr(c) for c in range(0x3001) if chr(c).isspace()]


def random_text(rng: random.Random, size: int) -> str:
    alphabet = ["a", "Bc", "é", "dog", "9", ".", "!", "?", ". ", ".\n", "\n", " ", "  ", "\t", "\r\n", "# ", "## ", "### ",
                "\n## ", "\n### ", "```\n", "<h2>", "</h2>", "<h3 x>", "</H3>", "<p>", "|", "　", "\x85", "\x1c", "x" * 90]
    return "".join(rng.choice(alphabet) for _ in range(size))


def groups(sizes: list[int], limit: int) -> list[range]:
    """Greedy groups as index ranges, found by scanning running totals."""
    totals, out, first = [0, *accumulate(sizes)], [], 0
    while first < len(sizes):
        last = first + 1
        while last < len(sizes) and totals[last + 1] - totals[first] <= limit:
            last += 1
        out.append(range(first, last))
        first = last
    return out


def sentence_list(text: str) -> list[str]:
    ends = [0, *(m.end() for m in re.finditer(r"(?<=[.!?])\s+", text))]
    cut = [text[a:b] for a, b in zip(ends, [*ends[1:], len(text)])]
    return [s.rstrip() if i + 1 < len(cut) else s for i, s in enumerate(cut) if s.strip()]


def flat(text: str, target: int = 150) -> list[tuple]:
    """(text, start, end, tokens) per flat chunk."""
    body = text.strip()
    sents = sentence_list(body)
    sizes = [max(1, len(s) // 4) for s in sents]
    rows, at = [], 0
    for g in groups(sizes, target):
        joined = " ".join(sents[i] for i in g)
        end = at + len(joined)
        rows.append((joined, at, min(end, len(body)), sum(sizes[i] for i in g)))
        at = end + re.match(r"[ \n\t]*", body[end:]).end()
    return rows


def markdown(text: str) -> list[tuple]:
    """(level, heading, content, start, end) per non-empty section."""
    heads = [m for m in re.finditer(r"(?m)^(#{2,3})(?=[^\S\n])(?=..)([^\n]*)", text) if "\n" not in m[0]]
    starts = [h.start() for h in heads]
    rows = []
    if not starts or starts[0] > 0:
        stop = starts[0] if starts else len(text)
        rows.append((4, None, text[:stop].strip(), 0, stop - 1 if starts else len(text) + 1))
    for h, stop in zip(heads, [*starts[1:], None]):
        body = text[h.end() : stop].strip()
        rows.append((len(h[1]), h[2].strip(), body, h.start(), len(text) + 1 if stop is None else stop - 1))
    return [r for r in rows if r[2]]


def html(text: str) -> list[tuple]:
    def clean(s):
        return " ".join(re.sub(r"<[^>]+>", " ", s).split())

    heads = list(re.finditer(r"(?is)<(h[23])[^>]*>(.*?)</\1>", text))
    cuts = [h.start() for h in heads] + [len(text)]
    rows = [(4, None, clean(text[: cuts[0]]), 0, cuts[0])] if clean(text[: cuts[0]]) else []
    for h, stop in zip(heads, cuts[1:]):
        title = re.sub(r"<[^>]+>", "", h[2]).strip()
        rows.append((int(h[1][1]), title, clean(text[h.end() : stop]), h.start(), stop))
    return rows
