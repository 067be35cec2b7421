"""Where the chat tables come from and go to."""
