"""Unit conversions, signal levels and axis arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def to_db(x) -> Column:
    """10 log10(x); null where x is not positive."""
    x = _c(x)
    return F.when(x > 0, F.lit(10.0) * F.log10(x))


def from_db(x) -> Column:
    return F.pow(F.lit(10.0), _c(x) / 10.0)


def dbm_to_watt(x) -> Column:
    return F.pow(F.lit(10.0), (_c(x) - 30.0) / 10.0)


def watt_to_dbm(x) -> Column:
    return to_db(x) + 30.0


def snr_db(power, noise) -> Column:
    """SNR of data that already had the noise subtracted: 10 log10(power / noise)."""
    power, noise = _c(power), _c(noise)
    return F.when((power > 0) & (noise > 0), F.lit(10.0) * F.log10(power / noise))


def snr_excess_db(power, noise) -> Column:
    """SNR of raw power: 10 log10((power - noise) / noise)."""
    power, noise = _c(power), _c(noise)
    return F.when((power > noise) & (noise > 0), F.lit(10.0) * F.log10((power - noise) / noise))


def doppler_hz(channel_mhz, tx_mhz) -> Column:
    return (_c(channel_mhz) - _c(tx_mhz)) * 1e6


def global_sample(iter_, time_idx, block_len: int = 160) -> Column:
    return _c(iter_) * F.lit(block_len) + _c(time_idx)


def sample_micros(t0_micros, time_idx, sampling_time_s: float) -> Column:
    """Time of a sample in whole microseconds; the step is cut to whole nanoseconds first."""
    step_ns = int(sampling_time_s * 1e9)
    return _c(t0_micros) + F.floor(_c(time_idx).cast("bigint") * F.lit(step_ns) / F.lit(1000)).cast("bigint")


def pixel_slope_to_rate(slope, sampling_time_s: float, channel_hz: float) -> Column:
    """Channels per sample -> Hz per second."""
    return _c(slope) * F.lit(channel_hz / sampling_time_s)


def rate_to_pixel_slope(rate, sampling_time_s: float, channel_hz: float) -> Column:
    return _c(rate) * F.lit(sampling_time_s / channel_hz)


def line_through(x1, y1, x2, y2) -> tuple[Column, Column]:
    """Slope and intercept of the line through two points.

    A vertical line gives (infinity, 0), a horizontal one (0, 0).
    """
    x1, y1, x2, y2 = map(_c, (x1, y1, x2, y2))
    m = F.try_divide(y2 - y1, x2 - x1)
    slope = F.when(x1 == x2, F.lit(float("inf"))).when(y1 == y2, F.lit(0.0)).otherwise(m)
    icept = F.when((x1 == x2) | (y1 == y2), F.lit(0.0)).otherwise(y1 - m * x1)
    return slope, icept


def predicted_channel(doppler, tx_mhz, start_mhz, channel_mhz) -> Column:
    """Index of the channel on which a target with this Doppler shift shows up."""
    return F.floor((_c(tx_mhz) + _c(doppler) * 1e-6 - _c(start_mhz)) / _c(channel_mhz)).cast("int")


def adc_rf_dbm(rms, bits: int) -> Column:
    """RF level in dBm from the ADC RMS.

    Fixed values: 1.7 V full scale, 400 as impedance divisor, 12 dB front-end offset.
    """
    volts = _c(rms) * F.lit(1.7 / 2.0 ** bits)
    return to_db(volts * volts / 400.0) + 30.0 + 12.0


def attenuation_step(attenuation, level_dbm, target_dbm) -> Column:
    """New attenuator setting that brings a level to the target, 0 to 31.5 dB in 0.5 dB steps."""
    raw = _c(attenuation) - (_c(target_dbm) - _c(level_dbm))
    return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(31.5), raw)) * 2, 0) / 2


# Attenuation in dB that each bit of the attenuator code stands for, bit 0 first.
ATTENUATOR_BITS_DB = (0.5, 16.0, 1.0, 8.0, 2.0, 4.0)


def attenuator_db(code) -> Column:
    """dB value of an attenuator code."""
    code = _c(code).cast("int")
    total = F.lit(0.0)
    for bit, db in enumerate(ATTENUATOR_BITS_DB):
        total = total + F.getbit(code, F.lit(bit)) * F.lit(db)
    return total


def attenuator_code(db) -> Column:
    """Attenuator code of a dB value (cut to 0.5 dB)."""
    halves = F.floor(_c(db) * 2).cast("int")
    total = F.lit(0)
    for bit, unit in enumerate(ATTENUATOR_BITS_DB):
        position = int(unit * 2).bit_length() - 1
        total = total + F.getbit(halves, F.lit(position)) * F.lit(1 << bit)
    return total.cast("int")


def gain_advice_db(rms, target_rms) -> Column:
    """Gain that brings an RMS to the target; 0 for a dead input."""
    return F.when(_c(rms) > 0, F.lit(20.0) * F.log10(F.lit(target_rms) / _c(rms))).otherwise(F.lit(0.0))


def slew_seconds(delta_dec_deg) -> Column:
    """Time to move the dish in declination.  Fixed values: 15 s start-up, 4 degrees per minute."""
    return F.lit(15.0) + F.abs(_c(delta_dec_deg)) * 60.0 / 4.0


def antenna_label(ant) -> Column:
    """Cylinder-receiver label; four receivers per cylinder, both counted from 1."""
    ant = _c(ant)
    return F.concat_ws("-", (F.floor(ant / 4) + 1).cast("string"), (ant % 4 + 1).cast("string"))


def quantised_frequency(freq, rate, steps: int = 1024) -> Column:
    """Centre frequency rounded down to a whole step of the sampling rate."""
    return F.floor(_c(freq) / _c(rate) * steps) / steps * _c(rate)
