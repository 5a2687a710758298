"""Terms that a rendering must keep, and renderings of broadcast lines by patterns, as expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewater.functions.slots import DIGITS
from tidewater.functions.text import squeeze

# A pattern of the English line, and what of the Chinese one shows that the term was kept (the first is the usual one).
TERMS = (
    (r"\bSAINT JOHNS\b|\bSAINT JOHN\b", "圣约翰斯|圣约翰"),
    (r"\bINFORMATION FOXTROT\b|\bINFORMATION [A-Z]\b", "信息|通播|情报"),
    (r"\bWEATHER\b", "天气|气象"),
    (r"ZULU$(?<!RNAV ZULU)", "世界协调时|协调世界时|UTC"),
    (r"\bRNAV ZULU\b", r"RNAV\s*Z"),
    (r"\bWIND\b", "风向|风"),
    (r"\bVISIBILITY\b", "能见度"),
    (r"\bFEET\b", "英尺"),
    (r"\bTEMPERATURE\b", "温度"),
    (r"\bDEW POINT\b", "露点"),
    (r"\bMINUS\b", "零下|-|负"),
    (r"\bALTIMETER\b", "修正海压|高度表拨正|海压|修压"),
    (r"\bAPPROACH\b(?! RNAV)", "进近"),
    (r"\bRUNWAY\b", "跑道"),
    (r"\bGANDER\b", "冈德|甘德|Gander"),
    (r"\bCENTER\b", "中心"),
    (r"\bFREQUENCY\b", "频率"),
    (r"\bLANDING\b", "落地|着陆|降落"),
    (r"\bDEPARTING\b", "起飞|离场|出发"),
    (r"\bATC\b", "空管|管制|ATC"),
    (r"\bINITIAL CONTACT\b", "首次联系|初次联系|第一次联系"),
    (r"\bAS REQUESTED\b|\bWHEN REQUESTED\b", "按需|如需|需要时|要求时|按请求|按管制要求|当被要求"),
)
LETTERS = {"FOXTROT": "Foxtrot（F）", "ALFA": "Alfa（A）", "BRAVO": "Bravo（B）", "CHARLIE": "Charlie（C）", "DELTA": "Delta（D）", "ECHO": "Echo（E）"}
_D = "(?:" + "|".join(DIGITS) + ")"
RUN = rf"({_D}(?: {_D})*)"


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def audited(en: Column, zh: Column) -> Column:
    """(term, said, wanted, kept) for each term that the English line has: its pattern, what the line says, the usual rendering, and
    whether the Chinese line keeps it."""


    def found(both: Column) -> Column:
        line, other = both["en"], both["zh"]
        rows = [F.when(line.rlike(p), F.struct(F.lit(p).alias("term"), F.regexp_extract(line, p, 0).alias("said"), F.lit(want.split("|")[0]).alias("wanted"), other.rlike(want).alias("kept"))) for p, want in TERMS]
        return F.filter(F.array(*rows), lambda x: x.isNotNull())

    return once(F.struct(F.upper(en).alias("en"), zh.alias("zh")), found)


def _digits(words: Column) -> Column:
    for k, w in enumerate(DIGITS):
        words = F.replace(words, F.lit(w), F.lit(str(k)))
    return F.replace(words, F.lit(" "), F.lit(""))


def _plain(digits: Column) -> Column:
    """Without zeros in front."""
    return F.regexp_replace(digits, "^0+(?=.)", "")


def rendered(text: Column) -> Column:
    """The Chinese rendering of a line by the first of nine patterns that fits it whole; null if none does."""
    return once(squeeze(F.upper(text)), _rendered)


def _rendered(line: Column) -> Column:
    part = lambda p, k: _digits(F.regexp_extract(line, p, k))
    letter = lambda p: F.coalesce(F.create_map(*[F.lit(x) for kv in LETTERS.items() for x in kv])[F.regexp_extract(line, p, 1)], F.regexp_extract(line, p, 1))
    runway = lambda p: F.when(F.char_length(part(p, 1)) == 2, F.lpad(_plain(part(p, 1)), 2, "0")).otherwise(part(p, 1))
    # The patterns and their wording.
    weather = rf"^SAINT JOHNS INFORMATION (\w+) WEATHER AT {RUN} ZULU$"
    wind = rf"^WIND {RUN} AT {RUN}$"
    visibility = rf"^VISIBILITY {RUN} THOUSAND FEET$"
    temperature = rf"^TEMPERATURE {RUN} DEW POINT MINUS {RUN}$"
    altimeter = rf"^ALTIMETER {RUN}$"
    approach = rf"^APPROACH RNAV ZULU RUNWAY {RUN}$"
    frequency = rf"^INFORM GANDER CENTER ON FREQUENCY {RUN} DECIMAL {RUN} (AS REQUESTED|WHEN REQUESTED)$"
    landing = rf"^APPROACH ON INITIAL CONTACT LANDING AND DEPARTING RUNWAY {RUN}$"
    heard = r"^INFORM ATC THAT YOU HAVE INFORMATION (\w+)$"
    seen = part(visibility, 1)
    half = (F.char_length(seen) / 2).cast("int")
    # an even run of four digits or more is two numbers
    both = (F.char_length(seen) >= 4) & (F.char_length(seen) % 2 == 0)
    pressure = part(altimeter, 1)
    cases = {
        weather: F.concat(F.lit("圣约翰斯机场通播信息 "), letter(weather), F.lit("，气象观测时间 "), part(weather, 2), F.lit(" 世界协调时。")),
        wind: F.concat(F.lit("风向 "), part(wind, 1), F.lit("，风速 "), _plain(part(wind, 2)), F.lit(" 节。")),
        visibility: F.when(both, F.concat(F.lit("能见度 "), F.left(seen, half), F.lit("，云底高 "), _plain(F.concat(F.substring(seen, half + 1, half), F.lit("000"))), F.lit(" 英尺。"))).otherwise(F.concat(F.lit("能见度 "), seen, F.lit("。"))),
        temperature: F.concat(F.lit("温度 "), _plain(part(temperature, 1)), F.lit("℃，露点零下 "), _plain(part(temperature, 2)), F.lit("℃。")),
        altimeter: F.concat(F.lit("修正海压 "), pressure, F.when(F.char_length(pressure) == 4, F.concat(F.lit("（"), F.left(pressure, F.lit(2)), F.lit("."), F.substring(pressure, 3, 2), F.lit(" 英寸汞柱）"))).otherwise(""), F.lit("。")),
        approach: F.concat(F.lit("进近方式 RNAV Z，使用跑道 "), runway(approach), F.lit("。")),
        frequency: F.concat(F.when(F.regexp_extract(line, frequency, 3) == "AS REQUESTED", "如需引导可联系").otherwise("当被要求时联系"), F.lit("冈德中心，频率 "), part(frequency, 1), F.lit("."), part(frequency, 2), F.lit("。")),
        landing: F.concat(F.lit("落地和起飞使用跑道 "), runway(landing), F.lit("，首次联系进近时报告。")),
        heard: F.concat(F.lit("联系时告知管制（ATC）你已收到通播信息 "), letter(heard), F.lit("。")),
    }
    return F.coalesce(*[F.when(line.rlike(p), x) for p, x in cases.items()])
