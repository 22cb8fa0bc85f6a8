"""Small fixed dimension tables and code maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Number, first day, day after the last, party, name.
PRESIDENTS = (
    (47, "2025-01-20", "2029-01-20", "R", "Donald John Trump"),
    (46, "2021-01-20", "2025-01-20", "D", "Joseph Robinette Biden"),
    (45, "2017-01-20", "2021-01-20", "R", "Donald John Trump"),
    (44, "2009-01-20", "2017-01-20", "D", "Barack Hussein Obama"),
    (43, "2001-01-20", "2009-01-20", "R", "George Walker Bush"),
    (42, "1993-01-20", "2001-01-20", "D", "William Jefferson Clinton"),
    (41, "1989-01-20", "1993-01-20", "R", "George Herbert Walker Bush"),
    (40, "1981-01-20", "1989-01-20", "R", "Ronald Wilson Reagan"),
    (39, "1977-01-20", "1981-01-20", "D", "James Earl Carter"),
    (38, "1974-08-09", "1977-01-20", "R", "Gerald Rudolph Ford"),
    (37, "1969-01-20", "1974-08-09", "R", "Richard Milhous Nixon"),
    (36, "1963-11-22", "1969-01-20", "D", "Lyndon Baines Johnson"),
    (35, "1961-01-20", "1963-11-22", "D", "John Fitzgerald Kennedy"),
    (34, "1953-01-20", "1961-01-20", "R", "Dwight David Eisenhower"),
    (33, "1945-04-12", "1953-01-20", "D", "Harry S Truman"),
    (32, "1933-03-04", "1945-04-12", "D", "Franklin Delano Roosevelt"),
    (31, "1929-03-04", "1933-03-04", "R", "Herbert Clark Hoover"),
    (30, "1923-08-02", "1929-03-04", "R", "John Calvin Coolidge"),
    (29, "1921-03-04", "1923-08-02", "R", "Warren Gamaliel Harding"),
    (28, "1913-03-04", "1921-03-04", "D", "Thomas Woodrow Wilson"),
    (27, "1909-03-04", "1913-03-04", "R", "William Howard Taft"),
    (26, "1901-09-14", "1909-03-04", "R", "Theodore Roosevelt"),
    (25, "1897-03-04", "1901-09-14", "R", "William McKinley"),
    (24, "1893-03-04", "1897-03-04", "D", "Stephen Grover Cleveland"),
    (23, "1889-03-04", "1893-03-04", "R", "Benjamin Harrison"),
    (22, "1885-03-04", "1889-03-04", "D", "Stephen Grover Cleveland"),
    (21, "1881-09-19", "1885-03-04", "R", "Chester Alan Arthur"),
    (20, "1881-03-04", "1881-09-19", "R", "James Abram Garfield"),
    (19, "1877-03-04", "1881-03-04", "R", "Rutherford Birchard Hayes"),
    (18, "1869-03-04", "1877-03-04", "R", "Ulysses Simpson Grant"),
    (17, "1865-04-15", "1869-03-04", "D", "Andrew Johnson"),
    (16, "1861-03-04", "1865-04-15", "R", "Abraham Lincoln"),
    (15, "1857-03-04", "1861-03-04", "D", "James Buchanan"),
    (14, "1853-03-04", "1857-03-04", "D", "Franklin Pierce"),
)

#: First day, day after the last, party that controls the House, and the Senate.
CONTROL = (
    ("1977-01-03", "1981-01-03", "D", "D"),
    ("1981-01-03", "1987-01-03", "D", "R"),
    ("1987-01-03", "1995-01-03", "D", "D"),
    ("1995-01-03", "2001-01-03", "R", "R"),
    ("2001-01-03", "2001-06-06", "R", "R"),
    ("2001-06-06", "2003-01-03", "R", "D"),
    ("2003-01-03", "2007-01-03", "R", "R"),
    ("2007-01-03", "2011-01-03", "D", "D"),
    ("2011-01-03", "2015-01-03", "R", "D"),
    ("2015-01-03", "2019-01-03", "R", "R"),
    ("2019-01-03", "2021-01-20", "D", "R"),
    ("2021-01-20", "2023-01-03", "D", "D"),
    ("2023-01-03", "2025-01-03", "R", "D"),
    ("2025-01-03", "2027-01-03", "R", "R"),
)

#: Postal codes of states and territories.
STATES = {
    "Alabama": "AL", "Alaska": "AK", "Arizona": "AZ", "Arkansas": "AR", "California": "CA", "Colorado": "CO", "Connecticut": "CT",
    "Delaware": "DE", "Florida": "FL", "Georgia": "GA", "Hawaii": "HI", "Idaho": "ID", "Illinois": "IL", "Indiana": "IN", "Iowa": "IA",
    "Kansas": "KS", "Kentucky": "KY", "Louisiana": "LA", "Maine": "ME", "Maryland": "MD", "Massachusetts": "MA", "Michigan": "MI",
    "Minnesota": "MN", "Mississippi": "MS", "Missouri": "MO", "Montana": "MT", "Nebraska": "NE", "Nevada": "NV", "New Hampshire": "NH",
    "New Jersey": "NJ", "New Mexico": "NM", "New York": "NY", "North Carolina": "NC", "North Dakota": "ND", "Ohio": "OH", "Oklahoma": "OK",
    "Oregon": "OR", "Pennsylvania": "PA", "Rhode Island": "RI", "South Carolina": "SC", "South Dakota": "SD", "Tennessee": "TN",
    "Texas": "TX", "Utah": "UT", "Vermont": "VT", "Virginia": "VA", "Washington": "WA", "West Virginia": "WV", "Wisconsin": "WI",
    "Wyoming": "WY", "District of Columbia": "DC", "Puerto Rico": "PR", "Virgin Islands": "VI", "Guam": "GU",
    "Northern Mariana Islands": "MP", "American Samoa": "AS",
}

#: Spellings of parties and their codes.
PARTIES = {
    "democrat": "D", "democratic": "D", "democracy": "D", "democrat party": "D", "democratic party": "D", "d": "D", "dem": "D",
    "republican": "R", "republicans": "R", "republican party": "R", "r": "R", "rep": "R",
    "federalist": "F", "f": "F", "whig": "W", "w": "W", "union": "U", "u": "U", "democratic-republican": "DR", "dr": "DR",
    "independent": "I", "i": "I", "libertarian": "L", "l": "L", "green": "G", "g": "G",
}

#: Titles of appointments that are no judgeships.
NON_JUDICIAL_TITLES = (
    "Administrator", "Ambassador", "Assistant", "Attorney", "Board", "Commission", "Chief Financial", "Director", "General Counsel",
    "Inspector General", "Legal Advisor", "Librarian", "Marshal", "Member of", "President", "Representative", "Secretary of",
    "Solicitor General", "Special Counsel", "Special Envoy", "Treasurer",
)

#: Words that tell of a judgeship.
JUDICIAL_TOKENS = ("judge", "justice", "circuit", "district", "bankruptcy", "judicial", "judiciary", "court", "magistrate")


def presidents(spark: SparkSession) -> DataFrame:
    """``number, start, end, party, name``; half-open intervals."""
    rows = spark.createDataFrame(PRESIDENTS, "number int, start string, end string, party string, name string")
    return rows.withColumns({c: F.to_date(c) for c in ("start", "end")})


def control(spark: SparkSession) -> DataFrame:
    """``start, end, house, senate``; half-open intervals."""
    rows = spark.createDataFrame(CONTROL, "start string, end string, house string, senate string")
    return rows.withColumns({c: F.to_date(c) for c in ("start", "end")})


def lookup(values: dict[str, str]):
    """A map literal."""
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
