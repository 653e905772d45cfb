"""Sky coordinates and antenna phases as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

SPEED_OF_LIGHT = 299792458.0  # m/s


def _c(x) -> Column:
    if isinstance(x, (int, float)):
        return F.lit(float(x))
    return F.col(x) if isinstance(x, str) else x


def positive_hour_angle(ha_deg) -> Column:
    """Hour angle wrapped to positive values and kept off zero."""
    ha = _c(ha_deg)
    return F.when(ha < 0, ha + 360.0).when(ha < 0.0001, F.lit(0.0001)).otherwise(ha)


def altitude_azimuth(ha_deg, dec_deg, lat_deg) -> tuple[Column, Column]:
    """Altitude and azimuth in radians.

    Azimuth is zero at the zenith, and its cosine snaps to -1 just above -1 and to +1 for
    every positive value (the rule the pointing tables in use were made with).
    """
    ha, dec, lat = F.radians(_c(ha_deg)), F.radians(_c(dec_deg)), F.radians(_c(lat_deg))
    alt = F.asin(F.sin(dec) * F.sin(lat) + F.cos(dec) * F.cos(lat) * F.cos(ha))
    ratio = F.try_divide(F.sin(dec) - F.sin(alt) * F.sin(lat), F.cos(alt) * F.cos(lat))
    snapped = (
        F.when((ratio < 0) & (ratio + 1 < 0.0001), F.lit(-1.0))
        .when((ratio > 0) & (ratio - 1 < 0.0001), F.lit(1.0))
        .otherwise(ratio)
    )
    az = F.acos(snapped)
    az = F.when(F.sin(ha) >= 0, F.lit(2 * math.pi) - az).otherwise(az)
    return alt, F.when(F.abs(_c(lat_deg) - _c(dec_deg)) < 0.01, F.lit(0.0)).otherwise(az)


def beam_azimuth_elevation(ref_dec_deg, ha_deg, delta_dec_deg, lat_deg) -> tuple[Column, Column]:
    """Azimuth and elevation (radians) of a beam given relative to the reference declination.

    The direction is expressed in the dish frame and turned back by the altitude and azimuth
    of the dish axis.
    """
    alt0, az0 = altitude_azimuth(F.lit(0.0), ref_dec_deg, lat_deg)
    ha, dd = F.radians(positive_hour_angle(ha_deg)), F.radians(_c(delta_dec_deg))
    vx, vy, vz = F.cos(ha) * F.cos(dd), -F.sin(ha) * F.cos(dd), F.sin(dd)
    ca, sa, cp, sp = F.cos(az0), -F.sin(az0), F.cos(alt0), -F.sin(alt0)
    x = cp * ca * vx - sa * vy + sp * ca * vz
    y = cp * sa * vx + ca * vy + sp * sa * vz
    z = -sp * vx + cp * vz
    return -F.atan2(y, x), F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), z)))


def scaled_hour_angle_pointing(ref_dec_deg, ha_deg, delta_dec_deg, lat_deg) -> tuple[Column, Column]:
    """The other pointing rule: hour angle stretched by 1/cos(dec), direct alt/az."""
    dec = _c(ref_dec_deg) + _c(delta_dec_deg)
    return altitude_azimuth(positive_hour_angle(_c(ha_deg) / F.cos(F.radians(dec))), dec, lat_deg)


def sub_band_mhz(start_mhz, bandwidth_mhz, sub, n_subs: int) -> Column:
    return _c(start_mhz) + _c(sub) * _c(bandwidth_mhz) / F.lit(n_subs)


def phase_weight(alt, az, east, north, up, frequency_mhz) -> tuple[Column, Column]:
    """Steering weight exp(-i k d) of an antenna displaced by (east, north, up) metres."""
    alt, az = _c(alt), _c(az)
    path = (F.sin(az) * F.cos(alt) * _c(east) + F.cos(az) * F.cos(alt) * _c(north)
            + F.sin(alt) * _c(up))
    phase = F.lit(2 * math.pi / SPEED_OF_LIGHT) * _c(frequency_mhz) * 1e6 * path
    return F.cos(phase), -F.sin(phase)
