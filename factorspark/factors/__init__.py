"""Factor libraries: named Column builders, computed together in one job."""

from factorspark.factors.base import Factor, compute_factors, list_factors, missing_factors, register_factor  # noqa: F401
from factorspark.factors import crypto, derivatives, indicators, price  # noqa: F401,E402
