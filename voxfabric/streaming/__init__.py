"""The viewer's state as a log of actions: batch windows and a stateful stream."""
