"""Where transfers come from and where a prepared table of them is kept."""
