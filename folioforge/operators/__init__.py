"""Table operators: DataFrame in, DataFrame out, all lazy unless the docstring says otherwise."""
