from .scalar import (  # noqa: F401
    day_of_week, hour_of_day, is_business_hours, is_error, is_server_error,
    parse_timestamp, risk_band, round_half_up,
)
