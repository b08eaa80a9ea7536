"""HLS playlists and ISO media as relations on Spark DataFrames."""
