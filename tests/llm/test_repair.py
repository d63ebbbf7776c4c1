import hashlib
import random
import re
import zlib
from itertools import product

import pytest

from thornwall.llm import repair
from thornwall.llm.queries import QUERIES


def slow_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(name.encode()) % 20
        if kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub("[.!?]", "", text)
        elif kind == 4:
            role = "user"
        if kind:
            out += [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return out


def initials(role):
    return role[:1] if role[:1] in ("s", "u", "a") else "o"


def slow_edits(rows, must, cut):
    """(cost, audit, lines): cheapest first over all ways, state by state."""
    legal = re.compile("(s?(ua)+)?")
    states = {"": (0, "", [])}  # by initials so far, shortened

    def shorten(s):
        return s if len(s) < 3 else ("ua" if s[-1] == "a" else "u")

    def put(found, key, value):
        key = shorten(key)
        if key not in found or value[:2] < found[key][:2]:
            found[key] = value

    def fits(s):
        return any(legal.fullmatch(s + rest) for rest in ("", "a", "ua"))

    def insert(found):
        for _ in range(4):
            for key, (cost, audit, lines) in list(found.items()):
                for role in ("user", "assistant"):
                    if fits(key + role[0]):
                        put(found, key + role[0], (cost + 2, audit + "I", [*lines, f"{role}:"]))
        return found

    for (role, text), delete, extra in zip(rows, must, cut, strict=True):
        after = {}
        for key, (cost, audit, lines) in insert(dict(states)).items():
            put(after, key, (cost + 3, audit + "D", lines))
            if delete:
                continue
            if initials(role) != "o" and fits(key + initials(role)):
                put(after, key + initials(role), (cost + extra, audit + "K", [*lines, f"{role}:{text}"]))
            for other in ("user", "assistant"):
                if fits(key + other[0]):
                    put(after, key + other[0], (cost + 2 + extra, audit + "R", [*lines, f"{other}:{text}"]))
        states = after
    return min(v for k, v in insert(dict(states)).items() if legal.fullmatch(k))


def slow(rows):
    by_conv = {conv: [] for conv, *_ in rows}
    for conv, turn, role, text in slow_damage(rows):
        by_conv[conv].append((turn, role, text))
    out = []
    for conv, turns in by_conv.items():
        digest = lambda r, t: hashlib.sha256(f"{len(r)}:{r}{t}".encode()).digest()
        turns.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], digest(x[1], x[2])))
        seen, must, cut, counts = set(), [], [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, role, text in turns:
            body = text.strip(repair.SPACE)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            must.append(fault in ("blank", "duplicate"))
            cut.append(int(fault == "truncated"))
        roles = "".join(initials(role) for _, role, _ in turns)
        illegal = sum(roles[i : i + 2] not in ("su", "ua", "au") for i in range(len(roles) - 1))
        numbers = {turn for turn, _, _ in turns if turn is not None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        cost, audit, lines = slow_edits([x[1:] for x in turns], must, cut)
        out.append((conv, gaps, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(map(str, out))


def table(spark, rows):
    rows = [(*r, 1, "x", None) for r in rows]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, cost int, conv string, known string").repartition(4)


def report(spark, rows):
    return sorted(str(tuple(r)) for r in repair.repair_report(repair.damage(table(spark, rows))).collect())


def made(rng, convs, longest):
    texts = ["Yes.", "No!", "What is it?", "cut off", "more of it, and", " ", "", None, "\t\n", "Tail. \x0b", "."]
    roles = ["system", "user", "assistant", "tool", "usr", "", None, "User"]
    weights = [1, 8, 8, 1, 1, 0.3, 0.3, 0.3]
    rows = []
    for conv in range(convs):
        for turn in range(rng.randint(1, longest)):
            text = f"Words {rng.randrange(99)}" + rng.choice([".", "!", "?", "", ","]) if rng.random() < 0.6 else rng.choice(texts)
            rows.append((conv, turn + rng.choice([0, 0, 0, 5]), rng.choices(roles, weights)[0], text))
    return rows


def test_the_table_matches_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(str(tuple(r)) for r in QUERIES["op13_repair"](spark, folder).collect()) == slow(rows)


def test_odd_conversations_match_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    rows = made(rng, 150, 9)
    rows += [(None, 1, "user", "A."), (None, 2, "assistant", "B."), (7, None, "user", "Nowhere."), (7, None, "user", None), (400, None, None, None)]
    rows += rows[:40]  # repeated rows
    rows += [(500 + n, n, "user", "Same text.") for n in range(60)]
    assert report(spark, rows) == slow(rows)
    assert report(spark, []) == []


def test_one_conversation_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(repair, "FAN", 3)
    rng = random.Random(9)
    rows = [(1, t, rng.choice(["user", "assistant", "assistant"]), f"Turn {rng.randrange(900)}{rng.choice(['.', '!', ''])}") for t in range(2500)]
    rows += [(2, t, ["user", "assistant"][t % 2], "Again and again.") for t in range(900)]
    rows += made(rng, 20, 6)
    assert report(spark, [(c + 10 if c < 20 and i >= 3400 else c, *r) for i, (c, *r) in enumerate(rows)]) == slow(
        [(c + 10 if c < 20 and i >= 3400 else c, *r) for i, (c, *r) in enumerate(rows)]
    )


@pytest.mark.parametrize("rows", [2, 5])
def test_strings_of_any_length_multiply_alike(rows):
    rng = random.Random(3)
    for _ in range(60):
        letters = "".join(rng.choice(repair.LETTERS) for _ in range(rng.randint(1, 40)))
        whole = repair.Grammar().matrix(letters)
        grammar = repair.Grammar(["ua", chr(0x100) * 2, "UA", "da"])
        total = None
        for at in range(0, len(letters), rows):
            part = grammar.matrix(letters[at : at + rows])
            total = part if total is None else repair.product(total, part)
        plain = lambda m: [[c and (c[0], str(c[1])) for c in line] for line in m]
        assert plain(total) == plain(whole) == plain(grammar.matrix(letters))


def test_cheapest_edits_over_all_ways():
    """Every edit sequence of short conversations, tried one by one."""
    legal = re.compile("(s?(ua)+)?")

    def ways(letters):
        for inserts in product(range(3), repeat=len(letters) + 1):
            for edits in product("DKR", repeat=len(letters)):
                for roles in product("ua", repeat=sum(inserts) + edits.count("R")):
                    left, out, audit, cost, good = list(roles), "", "", 0, True
                    for n in range(len(letters) + 1):
                        for _ in range(inserts[n]):
                            out, audit, cost = out + left.pop(), audit + "I", cost + 2
                        if n == len(letters):
                            break
                        letter, edit = letters[n], edits[n]
                        audit += edit
                        if edit == "D":
                            cost += 3
                        elif letter == "d" or edit == "K" and letter.lower() == "o":
                            good = False
                        else:
                            cost += letter.isupper() + 2 * (edit == "R")
                            out += letter.lower() if edit == "K" else left.pop()
                    if good and legal.fullmatch(out):
                        yield cost, audit

    for letters in ["".join(x) for n in (1, 2) for x in product(repair.LETTERS, repeat=n)] + ["auU", "usa", "odu", "sSa"]:
        matrix = repair.product(repair.Grammar().matrix(letters), repair._inserts())
        got = min((c[0], str(c[1])) for c in (matrix[0][0], matrix[0][3]) if c)
        assert got == min(ways(letters)), letters


def test_ropes_compare_as_texts():
    rng = random.Random(1)
    pool = [repair.Rope(x) for x in ("D", "K", "R", "I", "KD" * 30, "")]
    for _ in range(300):
        pool.append(rng.choice(pool) + rng.choice(pool))
    for _ in range(3000):
        a, b = rng.choice(pool), rng.choice(pool)
        if a.size + b.size < 5000:
            assert (a < b) == (str(a) < str(b)) and str(a + b) == str(a) + str(b)


def test_repaired_turns_hash_to_the_report(spark):
    rows = made(random.Random(12), 60, 8)
    turns = repair.damage(table(spark, rows))
    lines = {}
    for r in repair.repaired(turns).orderBy("conv_id", "place").collect():
        lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for r in repair.repair_report(turns).collect():
        assert hashlib.sha256("\n".join(lines.get(r.conv_id, [])).encode()).hexdigest() == r.repaired_sha256


def test_pairs_of_neighbours_are_counted():
    text = "aaaa\nuaua\nsu\n\n"
    assert dict(repair.pair_counts(text)) == {"aa": 2, "ua": 2, "au": 1, "su": 1}
    assert not repair.pair_counts("\n")
