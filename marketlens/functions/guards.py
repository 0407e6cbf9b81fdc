"""Argument checks made before a plan is built."""


def require_positive(**arguments):
    for name, value in arguments.items():
        if value is not None and value <= 0:
            raise ValueError(f"{name} must be greater than zero.")


# The dimensions whose values are few enough for one report row each.
DIMENSIONS = ("product_category", "customer_state")


def require_dimension(dimension):
    if dimension not in DIMENSIONS:
        raise ValueError(f"Unsupported dimension: {dimension}; choose from {DIMENSIONS}")


def require_columns(df, columns):
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"Missing required columns: {missing}")
