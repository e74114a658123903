"""Typed errors, raised on the driver before a plan is built."""

from __future__ import annotations


class SignalError(Exception):
    """Base of all errors of this package."""


class ConfigError(SignalError, ValueError):
    """A parameter out of its range."""


class ChannelError(ConfigError):
    """A channel layout that the source can't give, or that is ambiguous."""


class DeviceError(SignalError, LookupError):
    """No device, or more than one, fits a selector."""


class FormatError(SignalError, ValueError):
    """An audio container that can't be read or written."""


class ConsumedError(SignalError, RuntimeError):
    """A single-pass source was used twice."""


class DetectorError(SignalError, RuntimeError):
    """A detector that is missing, refused or malformed."""
