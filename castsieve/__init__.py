"""Cleaning and enriching media playlists and link tables on Spark."""

from .plans.clean import CleanOptions, CleanResult, clean_channels, clean_playlists
from .sources.playlists import read_playlists

__all__ = ["CleanOptions", "CleanResult", "clean_channels", "clean_playlists", "read_playlists"]
