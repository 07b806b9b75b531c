"""Physical-plan helpers: staged tables, prefix sums, exact quantiles, hash cut-offs, lookups."""
