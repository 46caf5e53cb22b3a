import re

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})

LONG = "The very same line that stands in many documents, again."
#: Null, empty and blank texts, repeated rows, equal ids, very long lines, other scripts, and a clashing extra column.
ODD = [
    (1, None, "a"), (2, "", "b"), (3, " \t\n ", None), (4, f"{LONG}\nshort\n{LONG}", "c"), (5, f"  {LONG.upper()}\t\nother\x0bwords", "d"),
    (6, LONG, "e"), (7, f"x\n{LONG}", "f"), (8, LONG + "\r\n", "g"), (8, LONG + "\r\n", "g"), (9, "é" * 39 + "\n" + "É" * 40, "h"),
    (10, "word " * 30_000, "i"), (11, "Zürich 😀 naïve\u2003Ωmega İstanbul ΣΑΣ <|endoftext|> don't 12½ ﬁ", "j"), (None, LONG, "k"), (-5, f"{LONG}\n" * 3, "l"),
]


def odd_documents(spark):
    """With columns whose names clash with those that operators use."""
    return spark.createDataFrame([(*r, 7, "x") for r in ODD], "doc_id long, text string, key string, shard int, words string")


def empty_documents(spark):
    return odd_documents(spark).limit(0)


NAV = re.compile(r"\W*(?:home|menu|log ?in|sign ?(?:in|up)|next|previous|back|search|contact(?: us)?|about(?: us)?|share|read more|skip to [a-z ]+)\W*\Z", re.I | re.A)
POLICY = re.compile(r"all rights reserved|terms of (?:use|service)|privacy policy|cookie policy|uses? cookies|enable javascript|lorem ipsum|click here|subscribe to our|copyright (?:\(c\)|©|\d{4})|spdx-license-identifier", re.I | re.A)
ENDS = set(".!?…:;\"'”’»)]。！？：；」』）】।॥؟۔؛።។៕။།")


def plain_line_fails(line):
    """The line rules of op3, character by character."""
    if not WORD.search(line):
        return False
    last = line.rstrip(" \t\n\x0b\x0c\r")[-1:]
    ended = last in ENDS or "ก" <= last <= "๛" or "ກ" <= last <= "ໟ"
    inside = any(c in ".!?…؟۔।።" and d in " \t\n\x0b\x0c\r" for c, d in zip(line, line[1:], strict=False)) or any(c in "。！？" for c in line)
    shouting = line.upper() == line and len(line) >= 20 and line.lower() != line
    noise = line.count("|") >= 4 or sum(c in "#*$%&|<>" for c in line) * 20 > len(line) or line.count("!!") >= 3
    return noise or shouting or bool(NAV.match(line)) or bool(POLICY.search(line)) or not (ended or inside)


def plain_clean(text):
    """The text that the quality stage leaves, or None where it rejects the document."""
    text = text or ""
    words = WORD.findall(text)
    windows = {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    repeated = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    lines = text.split("\n")
    good = [x for x in lines if not plain_line_fails(x)]
    total = sum(map(len, lines))
    if len(words) < 50 or 100 * len(repeated) > 50 * len(words) or not total or 1 - sum(map(len, good)) / total > 0.5:
        return None
    return "\n".join(good)
