"""Components of a postal address typed in Chinese, English or pinyin: road, lane number, building number, estate."""

from __future__ import annotations

import re
from typing import NamedTuple

from rookery.llm.names import ENDINGS, clean_estate, fold, han_number, romanize, undouble

# Kinds of road by locale, and the kind that each stands for.
ROAD_KINDS = {
    "zh": {"路": "lu", "街": "jie", "大道": "dadao"},
    "en": {"road": "lu", "rd": "lu", "street": "jie", "st": "jie", "avenue": "dadao", "ave": "dadao"},
    "pinyin": {"lu": "lu", "jie": "jie", "dadao": "dadao"},
}
# Words for a lane, a building and a room by locale.
PART_WORDS = {
    "en": {"lane": ("lane", "ln"), "building": ("building", "bldg", "no"), "room": ("room", "rm")},
    "pinyin": {"lane": ("nong",), "building": ("hao",), "room": ()},
}
_HAN = "一-鿿"
_NUM = r"[零〇一二三四五六七八九十百千两]+"
_BUILDING_END = r"(?:号楼|号|幢|栋|座|#)"
_NUMERAL = re.compile(rf"({_NUM})(?=弄|号|幢|栋|座|室)")
_ADMIN = re.compile(rf"^[{_HAN}]*?(?:市|街道|新区|度假区|工业园|[^小]区|镇|乡)(?=.)")
_ROAD = re.compile(rf"([{_HAN}]+?)(路|街(?!道)|大道)")
_KINDS = "|".join([*ROAD_KINDS["en"], *ROAD_KINDS["pinyin"]])
_LATIN_ROAD = re.compile(rf"([a-z]+(?: (?:dong|xi|nan|bei|zhong))?) ({_KINDS})\b\.?")
_LATIN_WORD = re.compile(rf"\b(?:{'|'.join([w for p in PART_WORDS.values() for ws in p.values() for w in ws] + [_KINDS])})\b")
_ESTATE = re.compile(rf"([{_HAN}]{{2,}}?(?:{'|'.join(sorted(ENDINGS, key=len, reverse=True))})(?:[一二三四1-4]期)?)(?![{_HAN}]*(?:路|街|大道))")
_REMARK = re.compile(r"附近|近地铁站?|可短租|电梯房|靠河边|进门右转|\d+\s*楼(?=$|[\s,、])")


class Parts(NamedTuple):
    road: str  # romanized name and direction, "" if missing
    kind: str  # lu, jie or dadao, "" if missing
    han: str  # the name in characters, "" if romanized
    lane: int  # 0 if missing
    building: int  # 0 if missing
    estate: str  # estate named in the address, cleaned
    phase: str


NOTHING = Parts("", "", "", 0, 0, "", "")


def _admin_off(s: str) -> str:
    """City, district and subdistrict taken off the front."""
    while True:
        t = _ADMIN.sub("", s, count=1)
        if t == s or not t:
            return s
        s = t


def _latin(s: str, pinyin: dict[str, str]) -> Parts:
    road, kind = "", ""
    for m in _LATIN_ROAD.finditer(s):
        name = m[1]
        if name.split()[0] in ("lane", "ln"):
            name = " ".join(name.split()[1:])
        if name:
            road, kind = name.replace(" ", ""), ROAD_KINDS["en"].get(m[2]) or ROAD_KINDS["pinyin"][m[2]]
            break
    m = re.search(r"\b(?:lane|ln)\.? ?(\d+)", s) or re.search(r"(\d+) ?(?:lane|ln|nong)\b", s)
    b = re.search(r"\b(?:building|bldg)\.? ?(\d+)", s) or re.search(r"\bno\.? ?(\d+)", s) or re.search(r"(\d+) ?hao\b", s)
    e = _ESTATE.search(s)
    estate, phase = clean_estate(e[1]) if e else ("", "")
    return Parts(road, kind, "", int(m[1]) if m else 0, int(b[1]) if b else 0, estate, phase)


def parse(address: str | None, pinyin: dict[str, str]) -> Parts:
    """Parts of an address; what it doesn't name is missing. Digits may be of any width or in characters, parts in any order."""
    if not address:
        return NOTHING
    s = fold(address)
    if len(_LATIN_WORD.findall(s)) >= 2:
        return _latin(s, pinyin)
    s = _NUMERAL.sub(lambda m: str(han_number(m[1])), s)
    s = re.sub(r"【[^】]*】", " ", s)
    s = _REMARK.sub(" ", s)
    s = re.sub(r"\d+\s*室|室", " ", s)
    lane = building = 0
    road = kind = ""
    # road lane-building, road lane弄/building/room
    m = re.search(rf"(路|街(?!道)|大道)\s*(\d+)\s*(?:弄)?\s*[-/]\s*(\d+)", s)
    if m:
        lane, building = int(m[2]), int(m[3])
    m = re.search(r"(\d+)\s*弄", s)
    if m:
        lane = int(m[1])
    if not building:
        m = re.search(rf"(\d+)\s*{_BUILDING_END}", s)
        building = int(m[1]) if m else 0
    # the road: the segment that ends in a kind of road, without the areas before it
    for seg in re.split(rf"[^{_HAN}]+|(?<=期)(?=\d)", s):
        seg = _admin_off(re.sub(r"^(?:弄内?|号楼?|幢|栋|室)+", "", seg))
        m = _ROAD.search(seg)
        if m:
            road, kind = undouble(m[1]), ROAD_KINDS["zh"][m[2]]
            break
    if lane and not road:
        m = re.search(rf"([{_HAN}]{{2,4}})\s*{lane}\s*弄", s)
        road = undouble(_admin_off(m[1])) if m else ""
    rest = s
    if road:
        rest = re.sub(rf"[{_HAN}]*?(?:路|街(?!道)|大道)", " ", rest, count=1)
    rest = re.sub(rf"\d+\s*(?:弄内?|{_BUILDING_END})", " ", rest)
    estate = phase = ""
    for seg in re.split(rf"[^{_HAN}0-9]+", rest):
        seg = _admin_off(seg)
        m = _ESTATE.search(seg)
        if m:
            estate, phase = clean_estate(m[1])
            break
    return Parts(romanize(road, pinyin), kind, road, lane, building, undouble(estate), phase)
