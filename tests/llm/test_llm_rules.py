import re
from collections import Counter

from conftest import ODD_TEXTS

from callscope.llm import quality_rules as rules


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts, repeated, seen, duplicate = Counter(windows), set(), set(), 0
    for i, window in enumerate(windows):
        if counts[window] > 1:
            repeated |= set(range(i, i + 5))
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            duplicate += line in seen
            seen.add(line)
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    failed = len(words) < 10 or 100 * len(repeated) > 20 * len(words)
    return len(words), sum(map(len, words)), symbols, duplicate, len(repeated), failed


def test_base_columns(documents):
    for row in documents.collect():
        assert rules.judge(row.text)[:6] == brute(row.text)
    for text in ("a b c d e " * 3, "a a a a a a", "x\ny\nx\n\n\nx", "\x85 \x1c　 a", "a b c d e f a b c d e"):
        assert rules.judge(text)[:6] == brute(text)


def test_lines():
    assert rules.line_rule("Home | News | Sport | Contact", 7) == "navigation"
    assert rules.line_rule("Buy*** now!! and%%% save&&& a$$$ lot### today*** here!!", 8) == "punctuation"
    assert rules.line_rule("Read more", 2) == "punctuation"
    assert rules.line_rule("We use cookies to improve this site and more.", 9) == "boilerplate"
    assert rules.line_rule("This is a whole sentence of prose.", 7) is None
    assert rules.clean_text("Menu\nA sentence with some words.\n\nHome | A | B") == "A sentence with some words.\n"
    assert rules.clean_text(None) == ""


def test_clean_prose_is_kept_and_menus_are_not():
    prose = "\n".join(f"a{k} b{k} c{k} says d{k} e{k} f{k} about g{k} h{k} and ends." for k in range(9))
    menu = "\n".join(f"Item {k} | More {k} | Next {k} | Last {k}" for k in range(9))
    assert rules.judge(prose)[6] and not rules.judge(menu)[6]


def test_query_on_odd_rows(odd):
    got = sorted((tuple(r)[:7] for r in rules.quality_rules(odd).collect()), key=str)
    assert got == sorted(((i, *brute(t or "")) for i, t, *_ in ODD_TEXTS), key=str)
    assert rules.quality_rules(odd.limit(0)).count() == 0
