"""Constants of the queries.  Defaults suit the tables at hand: dates run three years later than in
the published benchmarks, nations are numbered, and no part name holds "green"."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Orders:
    q1_ship_until: str = "2001-09-02"
    q3_segment: str = "BUILDING"
    q3_date: str = "1998-03-15"
    q5_region: str = "ASIA"
    year_from: str = "1997-01-01"
    year_to: str = "1998-01-01"
    q6_discount: tuple[str, str] = ("0.05", "0.07")
    q6_quantity: int = 24
    q9_name: str = "red"
    q18_quantity: int = 300
    qa_date: str = "1999-01-01"
    qa_quantity: int = 50


@dataclass(frozen=True)
class Star:
    nation: str = "NATION_1"
    cities: tuple[str, str] = ("NATION_3_1", "NATION_3_5")
    years: tuple[int, int] = (1995, 2000)
    late_years: tuple[int, int] = (2000, 2001)
    first_year: int = 1996
    month: int = 199701
    week: tuple[int, int] = (1997, 6)
    yearmonth: str = "Dec1997"
