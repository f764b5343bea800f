"""Names of places as typed by people: folding, decorations, phases, and a romanization learned from a reference list."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict

from pyspark.sql import DataFrame, Window, functions as F

# Traditional forms and their simplified ones, in pairs.
TRADITIONAL = dict(
    zip(
        "園莊華廣東書橋純寧樓閣蓮蔭榮鷺濤禮瀾雲樺繡楓詩麥樂蘇灣羅靜軒紗棲遠硯蘭號區鎮鄉縣門麗銀葉鳳龍馬鳥魚車長張陳劉吳楊趙鄭孫賀裡裏棟單層島國萬愛寶貝誠達帶燈點電動獨發飛豐風岡剛鋼崗關觀館歸貴漢紅後滬畫懷歡環匯會極濟際紀堅間節潔錦進經開凱藍連聯涼兩鄰臨靈嶺陸錄綠倫滿夢農寢慶親輕瓊權勝聖詩時實樹雙順絲頌嘆壇談騰鐵聽頭圖團萬圍偉溫聞務霧習賢顯縣線鄉響祥曉興學尋陽堯業藝憶陰銀應優遊魚園圓緣遠願躍運澤張鎮鐘眾莊資縱谿純濱滙沖鹽穀",
        "园庄华广东书桥纯宁楼阁莲荫荣鹭涛礼澜云桦绣枫诗麦乐苏湾罗静轩纱栖远砚兰号区镇乡县门丽银叶凤龙马鸟鱼车长张陈刘吴杨赵郑孙贺里里栋单层岛国万爱宝贝诚达带灯点电动独发飞丰风冈刚钢岗关观馆归贵汉红后沪画怀欢环汇会极济际纪坚间节洁锦进经开凯蓝连联凉两邻临灵岭陆录绿伦满梦农寝庆亲轻琼权胜圣诗时实树双顺丝颂叹坛谈腾铁听头图团万围伟温闻务雾习贤显县线乡响祥晓兴学寻阳尧业艺忆阴银应优游鱼园圆缘远愿跃运泽张镇钟众庄资纵溪纯滨汇冲盐谷",
        strict=True,
    )
)
# Endings of estate names and what stands for them in pinyin.
ENDINGS = {
    "家园": "jiayuan", "名邸": "mingdi", "小区": "xiaoqu", "公寓": "gongyu", "花园": "huayuan", "华庭": "huating",
    "新村": "xincun", "广场": "guangchang", "苑": "yuan", "里": "li", "大厦": "dasha", "山庄": "shanzhuang",
}
# English words that stand for any ending of an estate name.
ENGLISH_ENDINGS = ("homes", "terrace", "residence", "residences", "court", "lane", "garden", "gardens", "village", "estate", "apartments", "apartment", "mansion", "plaza", "square", "park", "tower", "house", "place")
# Endings of subdistricts.
DISTRICT_ENDINGS = {"街道": "jiedao", "新区": "xinqu", "镇": "zhen", "乡": "xiang"}
PHASES = {"1": "一期", "2": "二期", "3": "三期", "4": "四期", "i": "一期", "ii": "二期", "iii": "三期", "iv": "四期"}
HAN_DIGITS = {c: i for i, c in enumerate("零一二三四五六七八九")} | {"〇": 0, "两": 2}
UNKNOWN = "�□?？■"

_TABLE = str.maketrans(TRADITIONAL)
_INVISIBLE = re.compile("[​-‏⁠﻿­]")
_SYLLABLE = re.compile(r"(?:zh|ch|sh|[bpmfdtnlgkhjqxrzcsyw])?(?:iang|iong|uang|ang|eng|ing|ong|ian|iao|uai|uan|ai|ei|ao|ou|an|en|in|un|ia|ie|iu|ua|ui|uo|ue|er|a|o|e|i|u|v)$")


def fold(s: str) -> str:
    """One width, lower case, simplified characters, no invisible characters, single blanks, none outside."""
    s = unicodedata.normalize("NFKC", _INVISIBLE.sub("", s)).lower().translate(_TABLE)
    return re.sub(r"\s+", " ", s).strip()


def han_number(s: str) -> int:
    """Value of a number below ten thousand in Chinese characters."""
    if not any(c in s for c in "十百千"):
        return int("".join(str(HAN_DIGITS[c]) for c in s))
    total, digit = 0, 0
    for c in s:
        if c in HAN_DIGITS:
            digit = HAN_DIGITS[c]
        else:
            total += (digit or 1) * {"十": 10, "百": 100, "千": 1000}[c]
            digit = 0
    return total + digit


def undouble(s: str) -> str:
    """A character typed twice in a row counts once."""
    return re.sub(r"([一-鿿])\1+", r"\1", s)


_PHASE = re.compile(r"[\s(]*(?:第?([一二三四1-4])期|\b(i{1,3}|iv))\)?$")
_ROAD_PREFIX = re.compile(r"^.*(?:路|街(?!道)|大道)(?=.{2})")
_TRAIL = re.compile(r"(?:[\s\-—·,、]*(?:近地铁站?|地铁旁|地铁口|精装修?|业主直租|可短租|[东南西北]门|\d+\s*(?:号楼?|幢|栋|座)))+$")


def clean_estate(s: str | None) -> tuple[str, str]:
    """(name without decorations, phase) of a typed estate name; blanks for nothing."""
    if s is None:
        return "", ""
    s = fold(s)
    s = re.sub(r"[【】\[\]「」『』《》\"'“”]", "", s)
    s = re.sub(r"\((?!\s*[一二三四1-4]期|\s*i+\s*\))[^)]*\)", " ", s).strip()
    s = _TRAIL.sub("", s).strip()
    s = re.sub(r"^[^·]*[·•・]\s*", "", s)
    if re.search(r"[一-鿿]", s):
        s = re.sub(r"^[一-鿿]{2}区?\s+(?=[一-鿿" + re.escape(UNKNOWN) + "]{3})", "", s) if " " in s and len(s.split(" ")[0]) <= 3 and len(s.split(" ")[-1]) >= 4 else s
        s = _ROAD_PREFIX.sub("", s)
    phase = ""
    m = _PHASE.search(s)
    if m and m.start() > 0:
        phase = PHASES.get(m[1] or m[2], (m[1] or "") + "期")
        s = s[: m.start()].strip()
    if re.search(r"[一-鿿]", s):
        s = s.replace(" ", "")
    s = _TRAIL.sub("", s).strip(" -—·,、。.()!")
    return s, phase


def split_ending(name: str, endings: dict[str, str]) -> tuple[str, str]:
    """(stem, ending) of a name in characters."""
    for e in sorted(endings, key=len, reverse=True):
        if name.endswith(e) and len(name) > len(e):
            return name[: -len(e)], e
    return name, ""


def split_latin(name: str, endings: dict[str, str]) -> tuple[str, str]:
    """(stem, ending) of a romanized name; an English word or nothing gives an empty ending."""
    name = re.sub(r"[^a-z ]", "", name)
    words = name.split()
    back = {v: k for k, v in endings.items()}
    if len(words) > 1 and words[-1] in back:
        return "".join(words[:-1]), back[words[-1]]
    if len(words) > 1 and words[-1] in ENGLISH_ENDINGS:
        return "".join(words[:-1]), ""
    joined = "".join(words)
    for p in sorted(back, key=len, reverse=True):
        if joined.endswith(p) and len(joined) > len(p) + 3:
            return joined[: -len(p)], back[p]
    return joined, ""


def _segments(s: str, k: int) -> list[tuple[str, ...]]:
    """All ways to read s as k syllables."""
    if k == 0:
        return [()] if not s else []
    out = []
    for n in range(1, min(6, len(s)) + 1):
        if _SYLLABLE.match(s[:n]) and (n == len(s) or len(s) - n >= k - 1):
            out += [(s[:n], *r) for r in _segments(s[n:], k - 1)]
    return out


def learn_pinyin(pairs: list[tuple[str, str]]) -> dict[str, str]:
    """Syllable of each character, by vote over the ways in which the romanized names can be read."""
    cases = []
    for name, latin in pairs:
        if not name or not latin:
            continue
        words = latin.lower().split()
        rest, tail = name, []
        for w in reversed(words[1:]):
            got = next((k for k in range(1, 4) if k < len(rest) and _segments(w, k)), None)
            if got is None:
                break
            tail.append((rest[-got:], w))
            rest = rest[:-got]
        cases += [*tail, (rest, words[0])]
    read = [(n, _segments(w, len(n))) for n, w in cases]
    read = [(n, r) for n, r in read if r]
    votes: dict[str, Counter] = defaultdict(Counter)
    for n, r in read:
        for way in r:
            for c, y in zip(n, way):
                votes[c][y] += 1.0 / len(r)
    for _ in range(3):
        again: dict[str, Counter] = defaultdict(Counter)
        for n, r in read:
            best = max(r, key=lambda way: sum(votes[c][y] / sum(votes[c].values()) for c, y in zip(n, way)))
            for c, y in zip(n, best):
                again[c][y] += 1
        votes = again
    return {c: v.most_common(1)[0][0] for c, v in votes.items()}


#: Reference names from which the syllable of one character is learned, at most. The number of characters bounds the sample.
NAMES_OF_CHARACTER = 64
#: Letters of a romanized name that is learned from, at most; longer ones are no names.
LEARN_LETTERS = 64


def pinyin_of(ref: DataFrame, name: str = "name", latin: str = "name_pinyin", each: int = NAMES_OF_CHARACTER) -> dict[str, str]:
    """Learn from ``each`` names of every character, chosen by hash, so that no character is missed and row order doesn't matter.

    The result has one entry per character. Names that are null or not romanized teach nothing.
    """
    n = ref.where(F.col(name).isNotNull() & (F.length(latin) <= LEARN_LETTERS)).select(F.col(name).alias("n"), F.col(latin).alias("l")).distinct()
    chars = n.select("n", "l", F.explode(F.array_distinct(F.filter(F.split("n", ""), lambda c: c != ""))).alias("c"))
    w = Window.partitionBy("c").orderBy(F.xxhash64("n", "l"), "n", "l")  # the limit is applied before the shuffle
    got = chars.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= each).select("n", "l").distinct().collect()
    # Characters of endings and roads that a reference list may lack.
    return {"东": "dong", "西": "xi", "南": "nan", "北": "bei", "中": "zhong"} | learn_pinyin(sorted(tuple(r) for r in got))


def segment(letters: str, syllables: set[str]) -> list[str]:
    """One way to read letters as syllables: the fewest letters that are in none, then the fewest syllables, then the longest last.

    The same letters are always read alike, whatever their number, in one pass.
    """
    best: list[tuple[int, int, int]] = [(0, 0, 0)]  # letters in no syllable, syllables, length of the last one
    for i in range(1, len(letters) + 1):
        ways = []
        for n in range(min(6, i), 0, -1):
            known = letters[i - n : i] in syllables
            if known or n == 1:
                loose, count, _ = best[i - n]
                ways.append((loose + (not known), count + 1, -n))
        loose, count, n = min(ways)
        best.append((loose, count, -n))
    out, i = [], len(letters)
    while i:
        n = best[i][2]
        out.append(letters[i - n : i])
        i -= n
    return out[::-1]


def romanize(s: str, pinyin: dict[str, str]) -> str:
    return "".join(pinyin.get(c, c) for c in s)
