"""What a fact table looks like: its dimensions, its count, its year column."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# Column headers of the enrolment file and the names used here.
ENROLMENT_HEADERS = {
    "Fiscal Year": "fiscal_year",
    "Term Type": "term_type",
    "Career": "career",
    "Program Level": "program_level",
    "Study Year": "study_year",
    "Campus": "campus",
    "Faculty (group)": "faculty_group",
    "Program Grouping": "program_grouping",
    "Coop Regular": "coop_regular",
    "Work Term": "work_term",
    "Attendance": "attendance",
    "Visa Status": "visa_status",
    "Student Headcounts": "headcount",
}

# The nine dimensions a what-if run is summarised by.
SUMMARY_DIMS = (
    "fiscal_year",
    "term_type",
    "faculty_group",
    "visa_status",
    "coop_regular",
    "study_year",
    "program_level",
    "career",
    "attendance",
)

# Fixed value: the largest scenario grid accepted unless the caller lifts it.
MAX_COMBINATIONS = 100_000

REGISTRY_SCHEMA = T.StructType(
    [
        T.StructField("model", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("rmse", T.DoubleType()),
        T.StructField("r2", T.DoubleType()),
        T.StructField("mae", T.DoubleType()),
        T.StructField("is_best", T.BooleanType()),
    ]
)


@dataclass(frozen=True)
class CountSpec:
    """Names the columns of a fact table."""

    dims: tuple[str, ...]
    target: str = "headcount"
    year_dim: str | None = "fiscal_year"

    @classmethod
    def of(cls, df, target: str, year_dim: str | None = None) -> CountSpec:
        """Every column but the target is a dimension."""
        return cls(tuple(c for c in df.columns if c != target), target, year_dim)

    def with_dims(self, *dims: str) -> CountSpec:
        year = self.year_dim if self.year_dim in dims else None
        return CountSpec(tuple(dims), self.target, year)

    def fact_schema(self) -> T.StructType:
        columns = [T.StructField(d, T.StringType()) for d in self.dims]
        return T.StructType([*columns, T.StructField(self.target, T.LongType())])

    def request_schema(self) -> T.StructType:
        key = T.StructField("request_id", T.LongType(), nullable=False)
        return T.StructType(
            [key, *(T.StructField(d, T.StringType(), nullable=False) for d in self.dims)]
        )


# The full fact grain and the coarser grain models are trained on.
HEADCOUNT = CountSpec(
    (
        "fiscal_year",
        "term_type",
        "career",
        "program_level",
        "study_year",
        "campus",
        "faculty_group",
        "program_grouping",
        "coop_regular",
        "work_term",
        "attendance",
        "visa_status",
    ),
)
CELLS = HEADCOUNT.with_dims("fiscal_year", "term_type", "campus", "faculty_group", "attendance")
