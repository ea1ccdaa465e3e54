import math
import os
import re
from collections import Counter

from tilewright.llm import license_scan as ls

TERM = re.compile(ls.TERM)


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def brute(files):
    """[(licence, score, origin, origin_dir)] of (path, text) rows."""
    n, df = len(files), Counter()
    for _, t in files:
        df.update(set(TERM.findall(low(t or ""))))
    vec = lambda t: {k: c * (math.log((1 + n) / (1 + df[k])) + 1) for k, c in Counter(TERM.findall(t)).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    templates = [(name, vec(low(t)), len(TERM.findall(low(t))) > ls.LONG) for name, t in ls.TEMPLATES]

    def could(line):
        """Whether a line has terms that a line of some short template's cosine needs."""
        s = set(TERM.findall(line))
        for _, t, long in templates:
            share, total = 0.0, sum(x * x for x in t.values())
            for k in sorted(t, key=lambda k: (-df[k], k)):
                share += t[k] ** 2
                if not long and round(share / total, 9) >= round(ls.LEAST**2, 9) and k in s:
                    return True
        return False

    def cosine(u, t):
        v = vec(u)
        return round(sum(v[k] * t[k] for k in v.keys() & t.keys()) / norm(v) / norm(t), 6) if v else 0.0

    def units(path, text):
        """{unit: whether it is a whole licence file}"""
        text = low(text or "")
        raw = re.split("\r?\n", text)
        lines = [x.strip(" ") if could(x) else "" for x in raw]
        for x, kept in zip(raw, lines):  # the gate loses nothing
            assert kept or len(files) > 40 or not any(cosine(x, t) >= ls.LEAST for _, t, long in templates if not long)
        runs = [" ".join(r.split("\n")).strip(" ") for r in re.split("\n\n+", "\n".join(lines))]
        name = low(path or "").rsplit("/", 1)[-1]
        out = {x: False for x in [*lines, *runs] if x}
        if re.match(ls.LICENCE_FILE, name) and text.strip(" "):
            out[text.strip(" ")] = True
        return out

    all_units = [units(p, t) for p, t in files]
    bodies = {u for us in all_units for u, body in us.items() if body}

    def best(us):
        found = []
        for u, body in us.items():
            fits = [(name == ls.NOTICE, -c, name) for name, t, long in templates if u in bodies or not long if (c := cosine(u, t)) >= ls.LEAST]
            if fits:
                notice, c, name = min(fits)
                found.append((notice, not body, c, name))
        return (min(found)[3], -min(found)[2]) if found else None

    own = [best(us) for us in all_units]
    dirs = {}
    for (p, _), o in zip(files, own):
        if p is not None and o and re.match(ls.LICENCE_FILE, low(p).rsplit("/", 1)[-1]):
            d = os.path.dirname(p)
            dirs[d] = min(dirs.get(d, (0, "~")), (-o[1], o[0]))
    out = []
    for (p, _), o in zip(files, own):
        if o:
            out.append((*o, "own", None))
            continue
        d = None if p is None else os.path.dirname(p)
        while d is not None and d not in dirs:
            d = os.path.dirname(d) if d else None
        out.append((None, None, None, None) if d is None else (dirs[d][1], -dirs[d][0], "inherited", d))
    return out


MIT, GPL, CC = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0."


def run(spark, files):
    df = spark.createDataFrame([(i, p, t, "x") for i, (p, t) in enumerate(files)], "i long, path string, text string, licence string")
    got = ls.scan(df, spark.createDataFrame(ls.TEMPLATES, "licence string, text string")).collect()
    assert len(got) == len(files)
    return [tuple(r)[-4:] for r in sorted(got, key=lambda r: r.i)]


def test_scan_is_brute_force(spark, monkeypatch):
    long = ("plain words\n" * 2_000) + GPL
    files = [
        ("LICENSE", MIT), ("a/LICENSE.txt", GPL), ("a/b/x.py", "no header"), ("a/b/c/y.py", f"code\n{CC}\nmore"), ("a/z.py", ""), ("top.py", None), (None, "nothing"), (None, CC),
        ("d/copying", "all rights\nreserved"), ("d/e.py", "copyright nobody"), ("f/LICENCE", "words of no licence at all"), ("f/g.py", "x"), ("h/long.py", long), ("a/dup.py", MIT), ("a/dup.py", MIT),
        ("k/m.py", f"x\n{MIT}\n{CC}\ny\n\n{GPL}"), ("a/notice", CC), ("m/crlf.py", f"one\r\n{MIT}\r\nAll rights reserved.\r\n"), ("m/r.py", "All rights reserved."),
        ("m/CC.md", "The work is free: cc by 4.0, licensed."), ("n/license", "Read it:\n" + dict(ls.long_texts())["MPL-2.0"]),
    ]
    want = brute(files)
    assert run(spark, files) == want
    assert want[2] == ("CC-BY-NC-4.0", 1.0, "inherited", "a")
    assert want[5][2] == "inherited" and want[5][3] == ""
    monkeypatch.setattr(ls, "BROADCAST", -1)
    assert run(spark, files) == want


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [("a", "nothing here")]) == [(None, None, None, None)]
