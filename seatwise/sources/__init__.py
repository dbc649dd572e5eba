"""Contracts, IO and adapters for the four inputs and two models."""

from seatwise.sources import contracts, io, testdata

__all__ = ["contracts", "io", "testdata"]
