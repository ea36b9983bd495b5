"""Dates: periods, written dates, calendars and reconciliation. Unreadable values give null (ANSI mode is safe)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Month names.
EN_MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
RU_MONTHS = ("января", "февраля", "марта", "апреля", "мая", "июня", "июля", "августа", "сентября", "октября", "ноября", "декабря")
TR_MONTHS = ("ocak", "şubat", "mart", "nisan", "mayıs", "haziran", "temmuz", "ağustos", "eylül", "ekim", "kasım", "aralık")


def make_day(y: Column, m: Column, d: Column) -> Column:
    """A date of numbers; null if there is no such day."""
    return F.try_to_date(F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0")), "yyyy-MM-dd")


def _int(x: Column) -> Column:
    return x.try_cast("int")


def _named(text: Column, months: tuple[str, ...], day_first: bool) -> Column:
    names = "|".join(m if len(m) <= 4 or months is not EN_MONTHS else f"{m[:3]}(?:{m[3:]})?" for m in months)
    t = F.lower(text)
    if day_first:
        rx, di, mi, yi = f"(?u)(\\d{{1,2}})\\.?\\s+({names})\\.?,?\\s+(\\d{{4}})", 1, 2, 3
    else:
        rx, di, mi, yi = f"(?u)({names})\\.?\\s+(\\d{{1,2}}),?\\s+(\\d{{4}})", 2, 1, 3
    month = F.lit(None).cast("int")
    name = F.regexp_extract(t, rx, mi)
    for i, m in reversed(list(enumerate(months, 1))):
        month = F.when(name.startswith(m[:3]) & (name != "") & (name.startswith(m) | (F.length(name) == 3)), i).otherwise(month)
    return make_day(_int(F.regexp_extract(t, rx, yi)), month, _int(F.regexp_extract(t, rx, di)))


def en_date(text: Column) -> Column:
    """``March 5, 2024`` or ``5 Mar 2024``."""
    return F.coalesce(_named(text, EN_MONTHS, False), _named(text, EN_MONTHS, True))


def ru_date(text: Column) -> Column:
    return _named(text, RU_MONTHS, True)


def tr_date(text: Column) -> Column:
    return _named(text, TR_MONTHS, True)


def dmy(text: Column) -> Column:
    """``05.03.2024`` or ``5/3/2024``."""
    rx = "(?<!\\d)(\\d{1,2})[./](\\d{1,2})[./](\\d{4})(?!\\d)"
    return make_day(_int(F.regexp_extract(text, rx, 3)), _int(F.regexp_extract(text, rx, 2)), _int(F.regexp_extract(text, rx, 1)))


def ymd(text: Column) -> Column:
    """``2024-03-05``, ``2024/3/5``, ``2024.03.05`` or ``2024年3月5日``."""
    rx = "(?<!\\d)((?:19|20)\\d{2})[-/.年](\\d{1,2})[-/.月](\\d{1,2})"
    return make_day(_int(F.regexp_extract(text, rx, 1)), _int(F.regexp_extract(text, rx, 2)), _int(F.regexp_extract(text, rx, 3)))


def first_date(text: Column) -> Column:
    return F.coalesce(ymd(text), en_date(text), dmy(text), ru_date(text), tr_date(text))


def roc_date(text: Column) -> Column:
    """Years of the Republic (or Juche years, which count alike): + 1911."""
    rx = "(?<!\\d)(\\d{2,3})[-/.年](\\d{1,2})[-/.月](\\d{1,2})"
    return make_day(_int(F.regexp_extract(text, rx, 1)) + 1911, _int(F.regexp_extract(text, rx, 2)), _int(F.regexp_extract(text, rx, 3)))


def jalali_date(y: Column, m: Column, d: Column) -> Column:
    """Gregorian date of a Solar Hijri one, by the 33-year cycle (right from 1244 to 1472)."""
    leaps = F.floor((y * 8 + 21) / 33)
    days = (y - 1) * 365 + leaps + F.when(m <= 7, (m - 1) * 31).otherwise((m - 7) * 30 + 186) + (d - 1)
    anchor = 1402 * 365 + 340  # 1403-01-01 is 2024-03-20
    ok = (m.between(1, 12)) & (d >= 1) & (d <= F.when(m <= 6, 31).otherwise(30))
    return F.when(ok, F.date_add(F.lit("2024-03-20").cast("date"), (days - anchor).cast("int")))


def jalali_text(text: Column) -> Column:
    """``1403/01/15`` with any digits."""
    t = F.translate(text, "۰۱۲۳۴۵۶۷۸۹٠١٢٣٤٥٦٧٨٩", "01234567890123456789")
    rx = "(?<!\\d)(1[34]\\d{2})[-/.](\\d{1,2})[-/.](\\d{1,2})"
    return jalali_date(_int(F.regexp_extract(t, rx, 1)), _int(F.regexp_extract(t, rx, 2)), _int(F.regexp_extract(t, rx, 3)))


def tehran_date(stamp: Column) -> Column:
    """The local day of an ISO stamp: + 3:30 only if it says UTC."""
    utc = stamp.rlike("(Z|[+-]00:?00)$")
    at = F.try_to_timestamp(F.regexp_replace(F.substring(stamp, 1, 19), "T", " "))
    return F.when(utc, (at + F.expr("INTERVAL '3:30' HOUR TO MINUTE")).cast("date")).otherwise(at.cast("date"))


def inferred_year(month: Column, day: Column, captured: Column) -> Column:
    """A date without a year: the capture's year, or the one before if it would lie after the capture."""
    this = make_day(F.year(captured), month, day)
    return F.when(this <= captured, this).otherwise(make_day(F.year(captured) - 1, month, day))


def reconciled(page: Column, url: Column, today: Column) -> Column:
    """The page's date, but the URL's if the page's is in the future or more than 3 days away from it."""
    off = (page > today) | (F.abs(F.datediff(page, url)) > 3)
    return F.when(page.isNull() | (F.coalesce(off, F.lit(False)) & url.isNotNull()), url).otherwise(page)


def term_at(date: Column, terms: list[tuple[str, str]]) -> Column:
    """The holder of an office on a day; ``terms`` are (first day, name) in order."""
    out = F.lit(None).cast("string")
    for first, name in terms:
        out = F.when(date >= F.lit(first).cast("date"), name).otherwise(out)
    return out


def period_range(period: Column) -> Column:
    """``struct<lo, hi>`` of a week's Monday (yyyy-MM-dd) or a month (yyyy-MM)."""
    day = F.try_to_date(F.when(F.length(period) == 10, period).otherwise(F.concat(period, F.lit("-01"))), "yyyy-MM-dd")
    return F.struct(day.alias("lo"), F.when(F.length(period) == 10, F.date_add(day, 6)).otherwise(F.last_day(day)).alias("hi"))


def months_between(lo: Column, hi: Column) -> Column:
    """First days of months, newest first."""
    return F.reverse(F.sequence(F.trunc(lo, "month"), F.trunc(hi, "month"), F.expr("INTERVAL 1 MONTH")))


def utc_stamp(text: Column) -> Column:
    """An ISO time stamp as a UTC timestamp; without an offset it is UTC. Null if missing or malformed."""
    t = F.regexp_replace(F.nullif(F.trim(text), F.lit("")), "Z$", "+00:00")
    whole = F.when(t.rlike("^\\d{4}-\\d{2}-\\d{2}$"), F.concat(t, F.lit("T00:00:00+00:00"))).when(t.rlike("[+-]\\d{2}:?\\d{2}$"), t).otherwise(F.concat(t, F.lit("+00:00")))
    return F.when(whole.rlike("^\\d{4}-\\d{2}-\\d{2}[T ]\\d{2}:\\d{2}"), F.try_to_timestamp(whole))


def cutoff(spec: Column, now: Column, zone: str = "UTC") -> Column:
    """The effective end of a snapshot: a date's end in ``zone``, or a time stamp, but no later than ``now``; ``now`` without either."""
    day_end = F.to_utc_timestamp(F.concat(spec, F.lit(" 23:59:59")).try_cast("timestamp_ntz").cast("timestamp"), zone)
    asked = F.when(F.coalesce(spec, F.lit("")) == "", now).when(F.length(spec) == 10, day_end).otherwise(utc_stamp(spec))
    return F.least(asked, now)
