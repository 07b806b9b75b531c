"""Table operators: DataFrame (+ fitted table) in, DataFrame out."""
