"""Where transfers come from and go to."""
