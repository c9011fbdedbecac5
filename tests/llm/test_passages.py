import hashlib
import random
from collections import defaultdict

from sitemetry.llm import passages

from .helpers import documents, words

UNSPACED = [(0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3041, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)]
MARKS = ".!?…。！？।॥؟۔"


def alone(c):
    return any(a <= ord(c) <= b for a, b in UNSPACED)


def is_mark(c):
    return "!" <= c <= "~" and not c.isalnum() or "‐" <= c <= "⁞" or "　" <= c <= "〿" or "！" <= c <= "／" or "：" <= c <= "＠"


def units_of(text):
    """Units (part of the text, its words), read character by character."""
    tokens, at = [], 0
    while at < len(text):
        start = at
        while at < len(text) and text[at] in " \t\n\r\f":
            at += 1
        if at == len(text):
            break
        if alone(text[at]):
            at += 1
            while at < len(text) and is_mark(text[at]):
                at += 1
        else:
            while at < len(text) and text[at] not in " \t\n\r\f" and not alone(text[at]):
                at += 1
        tokens.append((text[start:at], "".join(c for c in text[start:at].lower() if c.isalnum())))
    tail = text[sum(len(t) for t, _ in tokens) :]
    sentences, fresh = [], True
    for token, word in tokens:
        if fresh or "\n" in token:
            sentences.append([])
        fresh = False
        sentences[-1].append((token, word))
        for c in reversed(token):
            if c.isalnum():
                break
            if c in MARKS:
                fresh = True
    units, lead = [], ""
    for sentence in sentences:
        if not any(w for _, w in sentence):  # without a word: a part of the unit before
            if units:
                units[-1][0] += "".join(t for t, _ in sentence)
            else:
                lead += "".join(t for t, _ in sentence)
            continue
        long = sum(1 for _, w in sentence if w) > passages.LONG
        new, within = True, 0
        for token, word in sentence:
            if not word:
                if units:
                    units[-1][0] += token
                else:
                    lead += token
                continue
            if new or (long and within == passages.LONG):
                units.append([lead + token, [word]])
                lead, within = "", 1
            else:
                units[-1][0] += token
                units[-1][1].append(word)
                within += 1
            new = long and hashlib.md5(word.encode()).hexdigest()[0] == "0"
    if units:
        units[-1][0] += tail
    return units


def brute(rows):
    """Text after removal and the number of removed units for rows (doc_id, text) of distinct ids."""
    units = {d: units_of(t or "") for d, t in rows}
    places = defaultdict(set)
    for d, u in units.items():
        for i in range(len(u)):
            for j in range(i + passages.SPAN - 1, len(u)):
                n = [len(w) for _, w in u[i : j + 1]]
                if sum(n) < passages.MIN_WORDS:
                    continue
                inner = [n[1:], n[:-1]]
                if any(len(x) < passages.SPAN or sum(x) < passages.MIN_WORDS for x in inner):  # the shortest from i or up to j
                    places[tuple(w for _, ws in u[i : j + 1] for w in ws)].add(((d is not None, d), i, j))
                if all(len(x) >= passages.SPAN and sum(x) >= passages.MIN_WORDS for x in inner):
                    break
    gone = defaultdict(set)
    for found in places.values():
        for (_, d), i, j in sorted(found)[1:]:
            gone[d] |= set(range(i, j + 1))
    return {d: (t, 0) if not gone[d] else ("".join(x for i, (x, _) in enumerate(units[d]) if i not in gone[d]).lstrip(" \t\n\r\f"), len(gone[d])) for d, t in rows}


def test_against_brute_force(spark):
    shared, lines = words(900, 60), "\n".join(words(950 + i, 7) for i in range(5))
    r = random.Random(4)
    chinese = "".join("".join(r.choice("天地人你我他大小上下来去有无中国") for _ in range(r.randrange(4, 9))) + "。" for _ in range(20))
    thai = "".join(r.choice("กขคงจฉชซญดตถทนบปผพฟมยรลวสหอ") for _ in range(300))
    rows = [(i, f"{words(i, 40)} {shared} {words(100 + i, 30)}") for i in range(6)]
    rows += [(10, lines), (11, lines + "\n" + words(77, 20) + "  "), (12, None), (13, ""), (14, "one two."), (15, f"Fff {shared.upper()}"), (16, words(5, 3) + " " + "Same line here now. " * 12)]
    rows += [(17, words(31, 20000)), (18, "x" * 50_000), (19, words(800, 170).replace(".", ",")), (20, f"{words(801, 9)[:-1]} then {words(800, 170).replace('.', ',')} and {words(802, 9)}"), (None, shared)]
    rows += [(30, chinese), (31, "x " + chinese), (32, thai), (33, f"{thai[200:260]}{thai}"), (34, "*** !!\n-- a. *** b. | " + words(990, 50)), (35, words(990, 50) + "\n***\n"), (36, "As " * 300), (37, "Yes. No. " * 30)]
    got = {r["doc_id"]: (r["text"], r["removed_units"]) for r in passages.dedup_passages(documents(spark, rows)).collect()}
    want = brute(rows)
    assert {d: v for d, v in got.items() if v != want[d]} == {}
    assert got[None][1] == 0 and all(got[i][1] > 0 for i in (0, 1, 2, 3, 4, 5, 11, 15, 16, 20, 31, 33, 35, 36, 37))
    assert all(got[i] == (dict(rows)[i], 0) for i in (10, 12, 13, 14, 17, 18, 19, 30, 32, 34))
    assert len(got[31][0]) < 12 and len(got[20][0].split()) < 60


def test_passages_of_short_sentences_and_clean_texts(spark):
    """A repeated passage of over 50 words goes whatever its sentences are like; texts that repeat less stay."""
    short = " ".join(f"{a} {b}." for a, b in zip(words(1, 30).replace(".", "").split(), words(2, 30).replace(".", "").split(), strict=True))
    few = " ".join(words(3, 16).split())
    rows = [(1, f"{words(10, 40)} {short} {words(11, 40)}"), (2, f"{words(12, 40)} {short} {words(13, 40)}"), (3, f"{words(14, 60)} {few} {words(15, 60)}"), (4, f"{words(16, 60)} {few} {words(17, 60)}")]
    got = {r["doc_id"]: (r["text"], r["removed_units"]) for r in passages.dedup_passages(documents(spark, rows)).collect()}
    assert got[2][1] >= 29 and all(got[i] == (dict(rows)[i], 0) for i in (1, 3, 4))


def test_repeated_rows_empty_table_and_columns(spark):
    text = words(3, 80)
    df = documents(spark, [(1, text), (1, text), (2, text)])
    got = passages.dedup_passages(df)
    assert got.columns == [*df.columns, "removed_units"]
    assert sorted((r["doc_id"], r["text"], r["starts"]) for r in got.collect()) == [(1, text, "s"), (1, text, "s"), (2, "", "s")]
    assert passages.dedup_passages(df.limit(0)).count() == 0
    clash = spark.createDataFrame([(1, text, 5, 6), (2, text, 7, 8)], "doc_id long, text string, parts int, hit int")
    assert sorted((r["doc_id"], r["text"], r["parts"], r["hit"]) for r in passages.dedup_passages(clash).collect()) == [(1, text, 5, 6), (2, "", 7, 8)]
