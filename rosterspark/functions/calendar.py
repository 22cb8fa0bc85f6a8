"""Calendar arithmetic on date columns; null in, null out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def election_day(year: Column) -> Column:
    """The Tuesday after the first Monday of November."""
    return F.date_add(F.next_day(F.make_date(year, F.lit(10), F.lit(31)), "MO"), 1)


def _days_to(date: Column, remainder: int) -> Column:
    year = F.year(date)
    first = year + F.pmod(F.lit(remainder) - year, F.lit(4))
    here = election_day(first)
    return F.datediff(F.when(date > here, election_day(first + 4)).otherwise(here), date)


def days_to_presidential_election(date: Column) -> Column:
    """0 on the day; years that four divides."""
    return _days_to(date, 0)


def days_to_midterm(date: Column) -> Column:
    """0 on the day; even years that four does not divide."""
    return _days_to(date, 2)


def term_index(date: Column, start: Column) -> Column:
    """1 for the first four years since ``start``, in years of 365.2425 days; null before it."""
    days = F.datediff(date, start)
    return F.when(days >= 0, F.floor(F.floor(days / 365.2425) / 4).cast("int") + 1)


def days_into_term(date: Column, start: Column) -> Column:
    """1 on the first day of the term at hand."""
    return F.datediff(date, F.add_months(start, 48 * (term_index(date, start) - 1))) + 1


def later_terms(date: Column, start: Column) -> Column:
    """Number of terms before the one at hand."""
    return term_index(date, start) - 1


def congress_number(date: Column) -> Column:
    """Two-year congresses by calendar year, the first from 1789; null before 4 March 1789."""
    year = F.year(date)
    odd = F.when(year % 2 == 1, year).otherwise(year - 1)
    return F.when(date >= F.lit("1789-03-04").cast("date"), F.floor((odd - 1789) / 2).cast("int") + 1)


def congress_session(date: Column) -> Column:
    """1 in odd years, 2 in even ones."""
    return F.when(F.year(date) % 2 == 1, 1).when(F.year(date) % 2 == 0, 2)


#: First day of each era and its name; the last bound ends the last era.
ERAS = (("1900-01-01", "pre-2013"), ("2013-11-21", "2013-2017"), ("2017-04-06", "2017-2019"), ("2019-04-03", "post-2019"), ("2030-01-01", None))


def senate_era(date: Column) -> Column:
    out = None
    for (start, name), (end, _) in zip(ERAS, ERAS[1:]):
        inside = (date >= F.lit(start).cast("date")) & (date < F.lit(end).cast("date"))
        out = F.when(inside, name) if out is None else out.when(inside, name)
    return out


def alignment(president: Column, house: Column, senate: Column) -> dict[str, Column]:
    """Who stands with the president: all, all but the House, all but the Senate, none.  Null while a chamber is
    unknown; a president without party differs from both."""
    h, s = house.eqNullSafe(president), senate.eqNullSafe(president)
    known = house.isNotNull() & senate.isNotNull()
    flags = {"unified": h & s, "divided_opp_house": s & ~h, "divided_opp_senate": h & ~s, "fully_divided": ~h & ~s}
    return {name: F.when(known, flag) for name, flag in flags.items()}


def days_between(start: Column, end: Column) -> Column:
    return F.datediff(end, start)


def days_to_confirmation(start: Column, action_date: Column, action: Column) -> Column:
    """Days up to the latest action where that is a confirmation."""
    return F.when(F.lower(action).contains("confirmed"), F.datediff(action_date, start))


def approximate_date(year: Column, month: Column, day: Column) -> Column:
    """The full date if year, month and day make one, else 1 July of the year."""
    whole = F.try_to_timestamp(F.format_string("%04d-%02d-%02d", year, month, day), F.lit("yyyy-MM-dd")).cast("date")
    full = F.when(year.isNotNull() & month.isNotNull() & day.isNotNull(), whole)
    return F.coalesce(full, F.make_date(year, F.lit(7), F.lit(1)))


def approximate_birth(year: Column, month: Column, day: Column, today: Column | None = None) -> Column:
    """As :func:`approximate_date`; null in the future."""
    date = approximate_date(year, month, day)
    return F.when(date <= (F.current_date() if today is None else today), date)


def speed_class(days: Column) -> Column:
    return F.when(days < 30, "very fast").when(days < 90, "fast").when(days < 180, "moderate").when(days.isNotNull(), "slow")


def weeks(days: Column) -> Column:
    return days / 7


def months(days: Column) -> Column:
    return days / 30.44
