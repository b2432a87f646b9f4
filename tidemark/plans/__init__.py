"""Domain plans. Every public function maps DataFrames to a DataFrame."""
