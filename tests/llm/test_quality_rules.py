"""Base counts against brute force, and junk that a vocabulary cannot have seen."""

import base64
import random
import re
from collections import Counter

import pytest

from tests.llm.helpers import frame
from tidemark.llm import quality_rules as Q

ENGLISH = """All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience and
should act towards one another in a spirit of brotherhood. Everyone has the right to life, liberty and security of person.
No one shall be held in slavery or servitude; slavery and the slave trade shall be prohibited in all their forms."""
RUSSIAN = """Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны
поступать в отношении друг друга в духе братства. Каждый человек имеет право на жизнь, на свободу и на личную
неприкосновенность. Никто не должен содержаться в рабстве или в подневольном состоянии; рабство и работорговля
запрещаются во всех их видах. Никто не должен подвергаться пыткам или жестоким наказаниям."""
VIETNAMESE = """Tất cả mọi người sinh ra đều được tự do và bình đẳng về nhân phẩm và quyền. Mọi con người đều được tạo hóa ban cho
lý trí và lương tâm và cần phải đối xử với nhau trong tình anh em. Mọi người đều có quyền sống, quyền tự do và an toàn cá nhân.
Không ai bị bắt làm nô lệ hoặc bị cưỡng bức làm việc như nô lệ."""


def junk(kind: str) -> str:
    r = random.Random(3)
    data = r.randbytes(6000)
    lower, cyrillic = "abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщъыьэюя"
    if kind == "base64":
        return base64.encodebytes(data).decode()
    if kind == "hex":
        return "\n".join(data.hex()[i:i + 64] for i in range(0, 12_000, 64))
    letters = {"mixed case": lower + lower.upper(), "cyrillic": cyrillic}[kind]
    return " ".join("".join(r.choice(letters) for _ in range(r.randint(4, 12))) for _ in range(300))


@pytest.fixture(scope="module")
def judged(spark):
    docs = [ENGLISH, RUSSIAN, VIETNAMESE, *map(junk, ("base64", "hex", "mixed case", "cyrillic")), None, "", "a b c\na b c\n\n \n", "é # $\t*x\vy " * 30]
    got = Q.judge(frame(spark, list(enumerate(docs)))).collect()
    return docs, {r["doc_id"]: r for r in got}


def test_prose_is_kept_and_junk_rejected(judged):
    assert [judged[1][i]["kept"] for i in range(7)] == [True] * 3 + [False] * 4
    assert not any(judged[1][i]["base_failed"] for i in range(7))


def test_base_columns_equal_brute_force(judged):
    for i, text in enumerate(judged[0]):
        words = re.findall(r"[^ \t-\r]+", text or "")
        lines = [x for x in (text or "").split("\n") if re.search(r"[^ \t-\r]", x)]
        windows = Counter(zip(words, words[1:], words[2:]))
        again = {k + j for k in range(len(words) - 2) if windows[tuple(words[k:k + 3])] > 1 for j in range(3)}
        want = (len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(again))
        assert tuple(judged[1][i][c] for c in Q.COLUMNS) == want
        assert judged[1][i]["base_failed"] == (len(words) < 50 or 2 * len(again) > len(words))
